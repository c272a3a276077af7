from .rule import Rule

RULES = (
    Rule("required", lambda v, p: v.present(), sees_null=True),
    Rule("isdefault", lambda v, p: ~v.present()),
)
