"""Message texts by locale: fixed values that callers rely on."""

from __future__ import annotations

# Fixed values.
EN = {
    "required": "{field} is required",
    "isdefault": "{field} must be the default value",
    "eq": "{field} must be equal to {value}",
    "ne": "{field} must not be equal to {value}",
    "eq_ignore_case": "{field} must be equal to {value}",
    "ne_ignore_case": "{field} must not be equal to {value}",
    "email": "{field} must be a valid email address",
    "url": "{field} must be a valid URL",
    "uri": "{field} must be a valid URI",
    "http": "{field} must be a valid HTTP or HTTPS URL",
    "https": "{field} must be a valid HTTPS URL",
    "ip": "{field} must be a valid IP address",
    "ipv4": "{field} must be a valid IPv4 address",
    "ipv6": "{field} must be a valid IPv6 address",
    "cidr": "{field} must be a valid CIDR block",
    "cidrv4": "{field} must be a valid IPv4 CIDR block",
    "cidrv6": "{field} must be a valid IPv6 CIDR block",
    "hostname": "{field} must be a valid hostname",
    "hostname_port": "{field} must be a valid hostname and port",
    "hostname_rfc1123": "{field} must be a valid RFC1123 hostname",
    "fqdn": "{field} must be a valid fully qualified domain name",
    "port": "{field} must be a valid port",
    "uuid": "{field} must be a valid lowercase UUID",
    "uuid3": "{field} must be a valid lowercase UUID v3",
    "uuid4": "{field} must be a valid lowercase UUID v4",
    "uuid5": "{field} must be a valid lowercase UUID v5",
    "uuid_rfc4122": "{field} must be a valid RFC4122 UUID",
    "uuid3_rfc4122": "{field} must be a valid RFC4122 UUID v3",
    "uuid4_rfc4122": "{field} must be a valid RFC4122 UUID v4",
    "uuid5_rfc4122": "{field} must be a valid RFC4122 UUID v5",
    "ulid": "{field} must be a valid ULID",
    "tcp4": "{field} must be a valid IPv4 TCP address",
    "tcp6": "{field} must be a valid IPv6 TCP address",
    "tcp": "{field} must be a valid TCP address",
    "udp4": "{field} must be a valid IPv4 UDP address",
    "udp6": "{field} must be a valid IPv6 UDP address",
    "udp": "{field} must be a valid UDP address",
    "json": "{field} must be valid JSON",
    "datetime": "{field} must be a valid datetime",
    "regex": "{field} format is invalid",
    "e164": "{field} must be a valid E.164 phone number",
    "base32": "{field} must be a valid Base32 string",
    "base64": "{field} must be a valid Base64 string",
    "base64url": "{field} must be a valid Base64URL string",
    "base64rawurl": "{field} must be a valid unpadded Base64URL string",
    "hexadecimal": "{field} must be a valid hexadecimal string",
    "url_encoded": "{field} must be a valid URL-encoded string",
    "html": "{field} must contain a valid HTML tag",
    "html_encoded": "{field} must contain a valid HTML entity",
    "jwt": "{field} must be a valid JWT string",
    "mac": "{field} must be a valid MAC address",
    "semver": "{field} must be a valid semantic version",
    "origin": "{field} must be a valid HTTP(S) origin",
    "datauri": "{field} must be a valid Data URI",
    "latitude": "{field} must be a valid latitude",
    "longitude": "{field} must be a valid longitude",
    "ssn": "{field} must be a valid SSN",
    "md4": "{field} must be a valid MD4 hash",
    "md5": "{field} must be a valid MD5 hash",
    "sha256": "{field} must be a valid SHA256 hash",
    "sha384": "{field} must be a valid SHA384 hash",
    "sha512": "{field} must be a valid SHA512 hash",
    "ripemd128": "{field} must be a valid RIPEMD128 hash",
    "ripemd160": "{field} must be a valid RIPEMD160 hash",
    "tiger128": "{field} must be a valid TIGER128 hash",
    "tiger160": "{field} must be a valid TIGER160 hash",
    "tiger192": "{field} must be a valid TIGER192 hash",
    "eth_addr": "{field} must be a valid Ethereum address",
    "mongodb": "{field} must be a valid MongoDB ObjectID",
    "mongodb_connection_string": "{field} must be a valid MongoDB connection string",
    "dns_rfc1035_label": "{field} must be a valid RFC1035 DNS label",
    "cve": "{field} must be a valid CVE identifier",
    "cron": "{field} must be a valid cron expression",
    "ein": "{field} must be a valid EIN",
    "bic_iso_9362_2014": "{field} must be a valid BIC/SWIFT code",
    "bic": "{field} must be a valid BIC/SWIFT code",
    "isbn": "{field} must be a valid ISBN",
    "isbn10": "{field} must be a valid ISBN-10",
    "isbn13": "{field} must be a valid ISBN-13",
    "issn": "{field} must be a valid ISSN",
    "credit_card": "{field} must be a valid credit card number",
    "luhn_checksum": "{field} must pass the Luhn checksum",
    "oneof": "{field} must be one of: {values}",
    "oneofci": "{field} must be one of: {values}",
    "noneof": "{field} must not be one of: {values}",
    "noneofci": "{field} must not be one of: {values}",
    "unique": "{field} must contain unique values",
    "contains": "{field} must contain {value}",
    "containsany": "{field} must contain any of: {value}",
    "containsrune": "{field} must contain rune {value}",
    "excludes": "{field} must not contain {value}",
    "excludesall": "{field} must not contain any of: {value}",
    "excludesrune": "{field} must not contain rune {value}",
    "startswith": "{field} must start with {value}",
    "endswith": "{field} must end with {value}",
    "startsnotwith": "{field} must not start with {value}",
    "endsnotwith": "{field} must not end with {value}",
    "ascii": "{field} must contain only ASCII characters",
    "printascii": "{field} must contain only printable ASCII characters",
    "multibyte": "{field} must contain a multibyte character",
    "alpha": "{field} must contain only letters",
    "alphaspace": "{field} must contain only letters and spaces",
    "alphaunicode": "{field} must contain only Unicode letters",
    "alphanum": "{field} must contain only letters and numbers",
    "alphanumspace": "{field} must contain only letters, numbers, and spaces",
    "alphanumunicode": "{field} must contain only Unicode letters and numbers",
    "numeric": "{field} must be numeric",
    "number": "{field} must be a number",
    "lowercase": "{field} must be lowercase",
    "uppercase": "{field} must be uppercase",
    "boolean": "{field} must be a boolean",
    "hexcolor": "{field} must be a hex color",
    "rgb": "{field} must be an RGB color",
    "rgba": "{field} must be an RGBA color",
    "hsl": "{field} must be an HSL color",
    "hsla": "{field} must be an HSLA color",
    "cmyk": "{field} must be a CMYK color",
    "iscolor": "{field} must be a valid color",
    "type": "{field} has invalid type, expected {expected}",
    "eq_field": "{field} must be equal to {compare}",
    "ne_field": "{field} must not be equal to {compare}",
    "gt_field": "{field} must be greater than {compare}",
    "gte_field": "{field} must be greater than or equal to {compare}",
    "lt_field": "{field} must be less than {compare}",
    "lte_field": "{field} must be less than or equal to {compare}",
    "fieldcontains": "{field} must contain {compare}",
    "fieldexcludes": "{field} must not contain {compare}",
    "required_if": "{field} is required",
    "required_unless": "{field} is required",
    "skip_unless": "{field} is required",
    "required_with": "{field} is required",
    "required_with_all": "{field} is required",
    "required_without": "{field} is required",
    "required_without_all": "{field} is required",
    "excluded_if": "{field} must be empty",
    "excluded_unless": "{field} must be empty",
    "excluded_with": "{field} must be empty",
    "excluded_with_all": "{field} must be empty",
    "excluded_without": "{field} must be empty",
    "excluded_without_all": "{field} must be empty",
}

# Fixed values.
ZH_CN = {
    "required": "{field}不能为空",
    "isdefault": "{field}必须是默认值",
    "eq": "{field}必须等于{value}",
    "ne": "{field}不能等于{value}",
    "eq_ignore_case": "{field}必须等于{value}",
    "ne_ignore_case": "{field}不能等于{value}",
    "email": "{field}格式不正确",
    "url": "{field}必须是有效的URL",
    "uri": "{field}必须是有效的URI",
    "http": "{field}必须是有效的HTTP或HTTPS URL",
    "https": "{field}必须是有效的HTTPS URL",
    "ip": "{field}必须是有效的IP地址",
    "ipv4": "{field}必须是有效的IPv4地址",
    "ipv6": "{field}必须是有效的IPv6地址",
    "cidr": "{field}必须是有效的CIDR",
    "cidrv4": "{field}必须是有效的IPv4 CIDR",
    "cidrv6": "{field}必须是有效的IPv6 CIDR",
    "hostname": "{field}必须是有效的主机名",
    "hostname_port": "{field}必须是有效的主机名和端口",
    "hostname_rfc1123": "{field}必须是有效的RFC1123主机名",
    "fqdn": "{field}必须是有效的完整域名",
    "port": "{field}必须是有效端口",
    "uuid": "{field}必须是有效的小写UUID",
    "uuid3": "{field}必须是有效的小写UUID v3",
    "uuid4": "{field}必须是有效的小写UUID v4",
    "uuid5": "{field}必须是有效的小写UUID v5",
    "uuid_rfc4122": "{field}必须是有效的RFC4122 UUID",
    "uuid3_rfc4122": "{field}必须是有效的RFC4122 UUID v3",
    "uuid4_rfc4122": "{field}必须是有效的RFC4122 UUID v4",
    "uuid5_rfc4122": "{field}必须是有效的RFC4122 UUID v5",
    "ulid": "{field}必须是有效的ULID",
    "tcp4": "{field}必须是有效的IPv4 TCP地址",
    "tcp6": "{field}必须是有效的IPv6 TCP地址",
    "tcp": "{field}必须是有效的TCP地址",
    "udp4": "{field}必须是有效的IPv4 UDP地址",
    "udp6": "{field}必须是有效的IPv6 UDP地址",
    "udp": "{field}必须是有效的UDP地址",
    "json": "{field}必须是有效的JSON",
    "datetime": "{field}必须是有效的日期时间",
    "regex": "{field}格式不正确",
    "e164": "{field}必须是有效的E.164手机号",
    "base32": "{field}必须是有效的Base32字符串",
    "base64": "{field}必须是有效的Base64字符串",
    "base64url": "{field}必须是有效的Base64URL字符串",
    "base64rawurl": "{field}必须是有效的无填充Base64URL字符串",
    "hexadecimal": "{field}必须是有效的十六进制字符串",
    "url_encoded": "{field}必须是有效的URL编码字符串",
    "html": "{field}必须包含有效的HTML标签",
    "html_encoded": "{field}必须包含有效的HTML实体编码",
    "jwt": "{field}必须是有效的JWT字符串",
    "mac": "{field}必须是有效的MAC地址",
    "semver": "{field}必须是有效的语义化版本号",
    "origin": "{field}必须是有效的HTTP(S)源",
    "datauri": "{field}必须是有效的Data URI",
    "latitude": "{field}必须是有效的纬度",
    "longitude": "{field}必须是有效的经度",
    "ssn": "{field}必须是有效的SSN",
    "md4": "{field}必须是有效的MD4哈希",
    "md5": "{field}必须是有效的MD5哈希",
    "sha256": "{field}必须是有效的SHA256哈希",
    "sha384": "{field}必须是有效的SHA384哈希",
    "sha512": "{field}必须是有效的SHA512哈希",
    "ripemd128": "{field}必须是有效的RIPEMD128哈希",
    "ripemd160": "{field}必须是有效的RIPEMD160哈希",
    "tiger128": "{field}必须是有效的TIGER128哈希",
    "tiger160": "{field}必须是有效的TIGER160哈希",
    "tiger192": "{field}必须是有效的TIGER192哈希",
    "eth_addr": "{field}必须是有效的以太坊地址",
    "mongodb": "{field}必须是有效的MongoDB ObjectID",
    "mongodb_connection_string": "{field}必须是有效的MongoDB连接字符串",
    "dns_rfc1035_label": "{field}必须是有效的RFC1035 DNS标签",
    "cve": "{field}必须是有效的CVE编号",
    "cron": "{field}必须是有效的cron表达式",
    "ein": "{field}必须是有效的EIN",
    "bic_iso_9362_2014": "{field}必须是有效的BIC/SWIFT代码",
    "bic": "{field}必须是有效的BIC/SWIFT代码",
    "isbn": "{field}必须是有效的ISBN",
    "isbn10": "{field}必须是有效的ISBN-10",
    "isbn13": "{field}必须是有效的ISBN-13",
    "issn": "{field}必须是有效的ISSN",
    "credit_card": "{field}必须是有效的信用卡号",
    "luhn_checksum": "{field}必须通过Luhn校验",
    "oneof": "{field}必须是以下值之一：{values}",
    "oneofci": "{field}必须是以下值之一：{values}",
    "noneof": "{field}不能是以下值之一：{values}",
    "noneofci": "{field}不能是以下值之一：{values}",
    "unique": "{field}不能包含重复值",
    "contains": "{field}必须包含{value}",
    "containsany": "{field}必须包含以下任一字符：{value}",
    "containsrune": "{field}必须包含字符{value}",
    "excludes": "{field}不能包含{value}",
    "excludesall": "{field}不能包含以下任一字符：{value}",
    "excludesrune": "{field}不能包含字符{value}",
    "startswith": "{field}必须以{value}开头",
    "endswith": "{field}必须以{value}结尾",
    "startsnotwith": "{field}不能以{value}开头",
    "endsnotwith": "{field}不能以{value}结尾",
    "ascii": "{field}只能包含ASCII字符",
    "printascii": "{field}只能包含可打印ASCII字符",
    "multibyte": "{field}必须包含多字节字符",
    "alpha": "{field}只能包含字母",
    "alphaspace": "{field}只能包含字母和空格",
    "alphaunicode": "{field}只能包含Unicode字母",
    "alphanum": "{field}只能包含字母和数字",
    "alphanumspace": "{field}只能包含字母、数字和空格",
    "alphanumunicode": "{field}只能包含Unicode字母和数字",
    "numeric": "{field}必须是数字",
    "number": "{field}必须是数字",
    "lowercase": "{field}必须是小写",
    "uppercase": "{field}必须是大写",
    "boolean": "{field}必须是布尔值",
    "hexcolor": "{field}必须是十六进制颜色",
    "rgb": "{field}必须是RGB颜色",
    "rgba": "{field}必须是RGBA颜色",
    "hsl": "{field}必须是HSL颜色",
    "hsla": "{field}必须是HSLA颜色",
    "cmyk": "{field}必须是CMYK颜色",
    "iscolor": "{field}必须是有效颜色",
    "type": "{field}类型不正确，期望{expected}",
    "eq_field": "{field}必须等于{compare}",
    "ne_field": "{field}不能等于{compare}",
    "gt_field": "{field}必须大于{compare}",
    "gte_field": "{field}必须大于或等于{compare}",
    "lt_field": "{field}必须小于{compare}",
    "lte_field": "{field}必须小于或等于{compare}",
    "fieldcontains": "{field}必须包含{compare}",
    "fieldexcludes": "{field}不能包含{compare}",
    "required_if": "{field}不能为空",
    "required_unless": "{field}不能为空",
    "skip_unless": "{field}不能为空",
    "required_with": "{field}不能为空",
    "required_with_all": "{field}不能为空",
    "required_without": "{field}不能为空",
    "required_without_all": "{field}不能为空",
    "excluded_if": "{field}必须为空",
    "excluded_unless": "{field}必须为空",
    "excluded_with": "{field}必须为空",
    "excluded_with_all": "{field}必须为空",
    "excluded_without": "{field}必须为空",
    "excluded_without_all": "{field}必须为空",
}

# Wording that depends on the kind of value, as (text, collection, other).
SIZES_EN = {
    "between": ("{field} length must be between {min} and {max}", "{field} size must be between {min} and {max}", "{field} must be between {min} and {max}"),
    "exact": ("{field} length must be exactly {exact}", "{field} size must be exactly {exact}", "{field} must be exactly {exact}"),
    "min": ("{field} length must be at least {min}", "{field} size must be at least {min}", "{field} must be at least {min}"),
    "max": ("{field} length must be at most {max}", "{field} size must be at most {max}", "{field} must be at most {max}"),
    "gt": ("{field} length must be greater than {value}", "{field} size must be greater than {value}", "{field} must be greater than {value}"),
    "gte": ("{field} length must be greater than or equal to {value}", "{field} size must be greater than or equal to {value}", "{field} must be greater than or equal to {value}"),
    "lt": ("{field} length must be less than {value}", "{field} size must be less than {value}", "{field} must be less than {value}"),
    "lte": ("{field} length must be less than or equal to {value}", "{field} size must be less than or equal to {value}", "{field} must be less than or equal to {value}"),
}
SIZES_ZH_CN = {
    "between": ("{field}长度必须在{min}到{max}之间", "{field}数量必须在{min}到{max}之间", "{field}必须在{min}到{max}之间"),
    "exact": ("{field}长度必须等于{exact}", "{field}数量必须等于{exact}", "{field}必须等于{exact}"),
    "min": ("{field}长度不能小于{min}", "{field}数量不能小于{min}", "{field}不能小于{min}"),
    "max": ("{field}长度不能大于{max}", "{field}数量不能大于{max}", "{field}不能大于{max}"),
    "gt": ("{field}长度必须大于{value}", "{field}数量必须大于{value}", "{field}必须大于{value}"),
    "gte": ("{field}长度必须大于或等于{value}", "{field}数量必须大于或等于{value}", "{field}必须大于或等于{value}"),
    "lt": ("{field}长度必须小于{value}", "{field}数量必须小于{value}", "{field}必须小于{value}"),
    "lte": ("{field}长度必须小于或等于{value}", "{field}数量必须小于或等于{value}", "{field}必须小于或等于{value}"),
}
