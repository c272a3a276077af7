"""The corpus operators against brute force, exact round trips and held-out accuracy, edge cases included."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checkframe.llm import arrays, decontamination, graph, language, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, sharding, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, key string, id string"
SYLLABLES = {"en": "the ing and of er on th is wh st re in".split(), "de": "sch ung der ein keit ver über ß ich pf au zu".split(), "ru": "по на ст ов ре ко та ни ро ла".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows_of(texts, langs=None):
    """Rows with columns whose names clash with those the operators use inside."""
    return [(i, t, (langs or {}).get(i, "en"), f"src{i % 3}", len(t) if t else None, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts, langs = [], {}
    for i in range(160):
        lang = ("en", "de", "ru")[i % 3]
        langs[i] = lang
        texts.append(".\n".join(sentence(rng, lang, rng.randint(8, 40)) for _ in range(rng.randint(1, 5))))
    for i in range(20):  # near copies, copies
        words = texts[i * 3].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words), texts[i * 3]]
    texts += ["", None, "   \n ", "one", "x" * 5000, "word " * 9000, "123 456", "a\nb", "É é ü"]
    return spark.createDataFrame(rows_of(texts, langs), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def test_words_and_shingles():
    texts = ["Ab c\td", "", None, "é  \x0bÉ", "a\x1cb"]
    batch = pa.record_batch({"text": pa.array(texts)})
    ((_, data, offsets),) = arrays.slices(batch)
    w = arrays.words(data, offsets)
    assert [int(n) for n in np.diff(w.first)] == [len(words(t)) for t in texts]
    found = [bytes(data[s : s + n]).lower() for s, n in zip(w.start, w.length, strict=True)]
    assert found == [x for t in texts for x in words(t)]
    h, doc = arrays.shingles(w, 3)
    assert sorted(doc.tolist()) == [0, 3, 4]
    assert list(arrays.slices(batch.slice(0, 0))) == []


def test_language(spark, docs):
    model = language.learn(docs.where("doc_id % 4 <> 1"))
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    known = [r for r in docs.where("doc_id < 160").collect()]
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in known]) > 0.97
    for r in docs.collect():
        spoken = r.text is not None and any(c.isalpha() for c in r.text)
        assert (found[r.doc_id].lang_pred == "und") == (not spoken) and 0 <= found[r.doc_id].score <= 1
    mixed = spark.createDataFrame([(1, sentence(random.Random(1), "en", 30) + " " + sentence(random.Random(2), "ru", 30))], "doc_id bigint, text string")
    got = [(r.lang, r.first_word, r.n_words) for r in language.spans(mixed, model).orderBy("first_word").collect()]
    assert got == [("en", 0, 30), ("ru", 30, 30)]
    assert language.predict(empty(spark), model).count() == 0
    nothing = language.learn(empty(spark))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(7, 3)).astype(np.float32)
    best = max(((sum(scores[i, p] for i, p in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))), path) for path in np.ndindex(*(3,) * 7))
    assert tuple(language.viterbi(scores, np.array([0, 7]), 0.7)) == best[1]


def brute_components(docs, n, percent):
    sets = {}
    for r in docs.collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, n):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, n=n).collect()}
    assert got == brute_components(docs, n, 80)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_crowds_of_near_copies(spark, monkeypatch):
    """Copies that differ from each other more than from their source, with small buckets and blocks."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "QUERY_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "MEMBER_BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(70):
        own = list(base)
        for _ in range(rng.choice([2, 5, 8, 11])):
            own[rng.randrange(120)] = f"e{k}x{rng.random()}"
        texts.append(" ".join(own))
    texts.insert(40, " ".join(base))
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame, n=2).collect()}
    assert got == brute_components(frame, 2, 80)


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    h = arrays.mix64(rng.integers(0, 2**62, size=900).astype(np.uint64))
    a, b = h[:800], h[100:]
    ra, rb, rab = (near_dedup.quantise(near_dedup.minima(x, np.zeros(len(x), dtype=np.int64), 1)) for x in (a, b, h))
    assert (near_dedup.merge(ra, rb) == rab).all()
    j = near_dedup.estimate(ra, rb, np.array([800.0]), np.array([800.0]))[0]
    assert abs(j - 700 / 900) < 0.12


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(len(label)):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == label


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    limits = packing.Limits(tokens=256, segments=6, loss=200)
    odd = spark.createDataFrame(rows_of(["It's <|endoftext|> here", "<|ENDOFTEXT|>", "a<|EndOfText|>b <|StartOfText|> <|startoftext|>c", "ÀÉ İstanbul don't 12a3", "éclair x y  z", "日本 語!! a.b.c"]), SCHEMA).withColumn("doc_id", F.col("doc_id") + 10_000)
    both = docs.unionByName(odd)
    pieces = packing.pack_documents(both, TOKENIZER, limits=limits).collect()
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    got = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        assert p.start == len(got[p.doc_id]) and p.length == len(p.ids) > 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes())
        got[p.doc_id] += p.ids
    for key, text in texts.items():
        assert got[key] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert sum(p.length for p in own) <= 256 and len(own) <= 6
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0
    prompted = packing.pack_documents(docs.where("doc_id < 20"), TOKENIZER, prompt_col="source", limits=packing.Limits(64, 4, 32)).collect()
    loss = collections.Counter()
    for p in prompted:
        quiet = len(tokenizer.encode(f"src{p.doc_id % 3}", add_special_tokens=False).ids)
        loss[p.sequence_id] += max(0, p.start + p.length - max(quiet, p.start))
    assert max(loss.values()) <= 32


def ascii_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        low = c.lower() if c.isascii() else c
        if not c.isascii() or (low.isalnum()):
            word += low
        elif word:
            out.append(word)
            word = ""
    return out


def test_decontamination(spark):
    rng = random.Random(2)
    items = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(40)) for _ in range(n)) for n in (5, 13, 20, 40)] + ["", None, "solo"]
    items.append(items[2])
    texts = []
    for i in range(60):
        w = [f"f{rng.randrange(50)}" for _ in range(rng.randrange(0, 60))]
        if i % 2:
            own = (items[i % 4]).split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = own[: rng.randint(1, len(own))]
        texts.append(" ".join(w).upper() if i % 3 else ", ".join(w))
    texts += [None, "", "SOLO", "solo " * 30, items[3] + " " + items[3]]
    docs = spark.createDataFrame(rows_of(texts) + [rows_of(texts)[1]], SCHEMA)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id bigint, text string")
    for r in decontamination.decontaminate(docs, bench).collect():
        w, hit, names = ascii_words(texts[r.doc_id]), set(), set()
        for k, t in enumerate(items):
            own = ascii_words(t)
            n = min(13, len(own))
            for s in range(len(own) - n + 1 if own else 0):
                for d in range(len(w) - n + 1):
                    if w[d : d + n] == own[s : s + n]:
                        hit |= set(range(d, d + n))
                        names.add(str(k))
        assert (r.n_words, r.n_hit, sorted(r.item_ids), r.contaminated) == (len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w))
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    clean = decontamination.decontaminate(docs, bench.limit(0))
    assert clean.count() == len(texts) + 1 and clean.where("contaminated").count() == 0
    near = {(r.id, r.places >= 1) for r in decontamination.proximity(docs, bench).collect()}
    assert len(texts) - 1 in {i for i, _ in near}


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(spark, docs, law):
    got = sharding.shard(docs, shards=7, law=law).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(7))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        total, most = sum(r.size for r in got), max(r.size for r in got)
        assert all(abs(sum(r.size for r in got if r.shard == s) - total / 7) <= most + 1 for s in by)
    assert sharding.shard(empty(spark), law=law).count() == 0


def test_hilbert_curve_moves_one_cell_a_step():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(np.ndindex(*(1 << bits,) * dims)))
        at = sharding.hilbert_index(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def labelled(spark, docs):
    """Every fifth document is bad: stuttering and full of insults."""
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 2, F.concat(F.col("text"), F.lit(" you idiot moron. " + "blah " * 30))).otherwise(F.col("text")))
    return changed, changed.where("doc_id < 150").select("doc_id", (F.col("doc_id") % 5 != 2).cast("int").alias("quality"), (F.col("doc_id") % 5 == 2).cast("int").alias("toxic"))


def test_quality_classifier(spark, docs):
    changed, labels = labelled(spark, docs)
    model = quality_classifier.learn(changed.where("doc_id % 3 > 0"), labels, label="quality")
    got = {r.doc_id: r.score for r in quality_classifier.score(changed, model).collect()}
    held = [i for i in range(0, 150, 3)]
    assert np.mean([(got[i] >= 0.5) == (i % 5 != 2) for i in held]) > 0.95
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.learn(docs, labels.limit(0), label="quality")).collect()} == {0.5}
    assert quality_classifier.score(empty(spark), model).count() == 0


def test_toxicity(spark, docs):
    changed, labels = labelled(spark, docs)
    model = toxicity.learn(changed.where("doc_id % 3 > 0"), labels)
    got = {r.doc_id: r.score for r in toxicity.score(changed, model).collect()}
    held = [i for i in range(0, 150, 3)]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 2) for i in held]) > 0.95
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(docs, toxicity.learn(empty(spark), labels)).count() == docs.count()
    assert toxicity.score(empty(spark), model).count() == 0


def test_quality_rules(spark, docs):
    extra = spark.createDataFrame(rows_of(["a b c a b c", "x\ny\nx\n \n \nx", "%%% # é|<", "w " * 60]), SCHEMA).withColumn("doc_id", F.col("doc_id") + 10_000)
    both = docs.unionByName(extra)
    got = {r.doc_id: r for r in quality_rules.quality(both).collect()}
    for r in both.collect():
        text = r.text or ""
        w = text.encode().split()
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g.base_failed and g.kept)
    assert quality_rules.quality(empty(spark)).count() == 0


def test_lm_scores(spark, docs):
    train = F.col("doc_id") % 5 != 0
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, train, TOKENIZER, 49_408).collect()}
    rows = docs.collect()
    counts = collections.Counter(x for r in rows if r.doc_id % 5 for x in words(r.text))
    n_docs = sum(r.doc_id % 5 != 0 for r in rows)
    total, size = sum(counts.values()) + n_docs, len(counts) + 1
    for r in rows:
        w, g = words(r.text), got[r.doc_id]
        base = sum(math.log10((counts[x] + 1) / (total + size + 1)) for x in w) + math.log10((n_docs + 1) / (total + size + 1))
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total)
        assert g.base_score == pytest.approx(base) and g.score < 0
    held = [got[r.doc_id] for r in rows if r.doc_id % 5 == 0 and r.doc_id < 160]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
    assert lm_scoring.lm_scores(empty(spark), train, TOKENIZER, 49_408).count() == 0


def test_lm_learns_from_all_training_documents(spark, monkeypatch):
    """Counts of ids and of pairs, pairs seen once included, cover each training document."""
    found, of = {}, lm_scoring.corpus_counts

    def counted(read, slot):
        by_id, pairs = of(read, slot)
        found.update(docs=read.count(), ids=by_id.sum(), pairs=pairs.sum(), once=(pairs == 1).sum(), ends=by_id[-1])
        return by_id, pairs

    monkeypatch.setattr(lm_scoring, "corpus_counts", counted)
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, "once upon").otherwise(F.concat(F.lit("the same "), F.col("id"))).alias("text"))
    lm_scoring.lm_scores(frame, F.col("doc_id") % 7 != 2, TOKENIZER, 49_408)
    assert found["docs"] == found["ends"] == sum(i % 7 != 2 for i in range(3000))
    assert found["ids"] == found["pairs"] >= 4 * found["docs"] and found["once"] >= 1


def small_vocabulary(rng, n_ids=5000):
    from checkframe.llm import attention as net

    counts = rng.integers(0, 50, size=n_ids).astype(float)
    return net.vocabulary(net.slots_of(counts), counts, rng.integers(0, 5, size=(net.SLOTS, net.SLOTS)).astype(np.float32))


def test_attention_gradients_and_probabilities():
    from checkframe.llm import attention as net

    rng = np.random.default_rng(2)
    vocab = small_vocabulary(rng)
    p = net.initial()
    p["cls"][:] = rng.normal(size=p["cls"].shape) / 4
    w = net.windows(rng.integers(0, 5000, size=90), np.array([0, 50, 50, 90]), vocab)
    assert int(w.scored.sum()) == 90
    target = vocab.cls[vocab.slot[w.target]]
    loss = net.gradients(p, vocab, w.slots, target, w.valid)
    for name in net.SHAPES:
        flat = loss[1][name].ravel()
        i = int(np.abs(flat).argmax())
        q = {k: v.astype(np.float64) for k, v in p.items()}
        eps = 1e-3
        up, down = ({**q, name: q[name].copy()} for _ in range(2))
        up[name].ravel()[i] += eps
        down[name].ravel()[i] -= eps
        slope = (net.gradients(up, vocab, w.slots, target, w.valid)[0] - net.gradients(down, vocab, w.slots, target, w.valid)[0]) / (2 * eps)
        assert slope == pytest.approx(flat[i], rel=0.05, abs=1e-4)
    at = np.array([3, 9])
    each = np.stack([net.log_class(p, vocab, w.slots, at, np.full(2, c)) for c in range(net.CLASSES)])
    assert np.exp(each).sum(axis=0) == pytest.approx([1, 1], rel=1e-3)
    before = w.slots.ravel()[at]
    for one in before:
        in_class = np.bincount(vocab.cls, np.exp(vocab.log_slot[one].astype(float)), minlength=net.CLASSES)
        assert in_class[np.unique(vocab.cls)] == pytest.approx(1, rel=1e-3)
    in_slot = np.bincount(vocab.slot, np.exp(vocab.log_share), minlength=net.SLOTS)
    assert in_slot[np.unique(vocab.slot)] == pytest.approx(1, rel=1e-3)


def test_attention_scores_against_brute_force():
    """Each id alone: its window by the rule of overlaps, attention over what stands before it, in plain loops."""
    from checkframe.llm import attention as net

    rng = np.random.default_rng(5)
    vocab = small_vocabulary(rng)
    p = net.initial()
    p["cls"][:] = rng.normal(size=p["cls"].shape) / 4
    ids, cuts = rng.integers(0, 5000, size=130), np.array([0, 70, 70, 71, 130])
    width = net.WIDTH
    want = np.zeros(4)
    for doc, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        own = ids[a:b]
        for i in range(len(own)):
            begin = 0 if i < net.WINDOW else (i - net.WINDOW) // net.STRIDE * net.STRIDE + net.STRIDE
            before = [net.START if j == 0 else int(vocab.slot[own[j - 1]]) for j in range(begin, i + 1)]
            x = [p["emb"][s].astype(float) + p["pos"][k] for k, s in enumerate(before)]
            y = [v @ p["qkv"].astype(float) for v in x]
            weight = [math.exp(y[-1][:width] @ v[width : 2 * width]) for v in y]
            mixed = sum(e * v[2 * width : 3 * width] for e, v in zip(weight, y, strict=True)) / sum(weight)
            z = (x[-1][:width] + mixed @ p["out"]) @ p["cls"] + vocab.log_class[before[-1]]
            slot = int(vocab.slot[own[i]])
            want[doc] += z[vocab.cls[slot]] - math.log(np.exp(z).sum()) + vocab.log_slot[before[-1], slot] + vocab.log_share[own[i]]
    assert lm_scoring.log_probability(ids, cuts, p, vocab) == pytest.approx(want, rel=1e-4)


def test_windows_overlap_by_eight_ids_at_least():
    from checkframe.llm import attention as net

    vocab = small_vocabulary(np.random.default_rng(1))
    w = net.windows(np.arange(200), np.array([0, 120, 200]), vocab)
    assert w.scored.sum() == 200
    later = w.scored[np.flatnonzero(w.doc == np.roll(w.doc, 1))]
    assert len(later) and later.argmax(axis=1).min() >= 8


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    item = docs.where("doc_id = 3").first().text.replace("\n", " ")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r.doc_id for r in frame.select("doc_id").collect()})
    assert seen[0] == {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    gone = seen[2] - seen[3]
    assert 3 in gone and all(i == 3 or i >= 160 for i in gone) and seen[4] == seen[3] <= seen[2]
    assert {i for i in range(160) if i != 3} <= seen[4]


def test_few_links_take_few_tasks(spark, monkeypatch):
    """Steps over few links are written by one task however many shuffle partitions there are; more links take more."""
    written, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (written.append(plain(df)), written[-1])[1])
    monkeypatch.setattr(graph, "release", lambda *kept: None)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(held, ("16", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 20 + (F.col("id") + 1) % 20).alias("b"))
        for rows_a_task, most in ((50_000, 1), (40, 4)):
            monkeypatch.setattr(graph, "TASK_LINKS", rows_a_task)
            written.clear()
            got = {r.id: r.label for r in graph.components(links).collect()}
            assert got == {i: i - i % 20 for i in range(60)}
            assert max(len(w.inputFiles()) for w in written) <= most and (most == 1 or max(len(w.inputFiles()) for w in written) > 1)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_texts_are_read_with_the_counts_of_common_words(spark):
    """Only the counts of common words travel to the tasks; ids come from the tokenizer, rare words are left in the text's order."""
    from tokenizers import Tokenizer

    common = lm_scoring.Given(b"the\ncat.", np.array([9, 4]))
    assert list(common.places([b"cat.", b"cat", b"the", b""])) == [1, -1, 0, -1]
    texts = ["The cat. sat\n\ton the Été, the", "", None, "  zzz cat ", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    read = lm_scoring.read_texts(docs, spark.sparkContext.broadcast(common), TOKENIZER, 49_408, 100.0, id_col="doc_id", text_col="text", train=F.col("doc_id") < 2)
    rows = {r.id: r for r in read.collect()}
    assert [(rows[i].train, rows[i].n_words, rows[i].n_known, rows[i].rare) for i in range(5)] == [(True, 7, 4, "sat on Été,"), (True, 0, 0, ""), (False, 0, 0, ""), (False, 2, 0, "zzz cat"), (False, 1, 1, "")]
    assert [rows[i].base for i in range(5)] == pytest.approx([3 * math.log10(0.1) + math.log10(0.05), 0, 0, 0, math.log10(0.1)])
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for i, text in enumerate(texts):
        assert list(np.frombuffer(rows[i].ids, dtype="<u2")) == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 49_408]


def test_a_text_is_summed_as_exactly_behind_a_long_one(spark):
    """Texts are read in large slices; a text's base sum owes nothing to the texts before it."""
    common = lm_scoring.Given(b"the\ncat.", np.array([9, 4]))
    texts = ["the cat. " * 150_000, "the cat. the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    read = lm_scoring.read_texts(docs, spark.sparkContext.broadcast(common), TOKENIZER, 49_408, 70.0, id_col="doc_id", text_col="text", train=F.lit(True))
    rows = {r.id: (r.n_words, r.n_known, r.base) for r in read.select("id", "n_words", "n_known", "base").collect()}
    assert rows[0][:2] == (300_000, 300_000) and rows[1][:2] == (3, 3)
    assert rows[1][2] == pytest.approx(2 * math.log10(10 / 70) + math.log10(5 / 70), abs=1e-14)


def test_fixed_parameters_are_multiplied_once_a_slice(monkeypatch):
    """Scoring looks up what slots and places give to queries, keys, values and classes; it agrees with the forward pass of training."""
    from checkframe.llm import attention as net

    rng = np.random.default_rng(8)
    vocab = small_vocabulary(rng)
    p = net.initial()
    p["cls"][:] = rng.normal(size=p["cls"].shape) / 4
    w = net.windows(rng.integers(0, 5000, size=3000), np.array([0, 2900, 2907, 2907, 3000]), vocab, net.WINDOW)
    target, at = vocab.cls[vocab.slot[w.target]], np.flatnonzero(w.valid)
    loss = -float(net.log_class(p, vocab, w.slots, at, target.ravel()[at]).mean())
    assert loss == pytest.approx(net.gradients(p, vocab, w.slots, target, w.valid)[0], rel=1e-5)
    made, fold = [], net.folded
    monkeypatch.setattr(net, "folded", lambda *given: (made.append(1), fold(*given))[1])
    monkeypatch.setattr(lm_scoring, "BLOCK", 16)
    lm_scoring.log_probability(rng.integers(0, 5000, size=3000), np.array([0, 2900, 2907, 2907, 3000]), p, vocab)
    assert made == [1]


def test_words_of_all_training_texts_are_counted(spark):
    """Blanks, null and empty texts hold no word; A-Z alone is lower-cased."""
    texts = [" The\tcat \n", None, "", "cat the Éé  x", "the"] * 40
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = collections.Counter(x for t in texts for x in words(t))
    assert {r.word.encode(): r.c for r in lm_scoring.word_counts(docs).collect()} == want
    assert lm_scoring.word_counts(docs.where("text is null")).count() == 0


def test_shares_of_very_low_scores_stay_finite():
    """What shares are divided by may be so small that its reciprocal is beyond a float32."""
    from checkframe.llm import attention as net

    q, k = (np.full((1, net.WINDOW, net.WIDTH), x, dtype=np.float32) for x in (-95 / net.WIDTH, 1))
    v = np.arange(net.WINDOW * net.WIDTH, dtype=np.float32).reshape(1, net.WINDOW, net.WIDTH)
    mixed = net._attend(q, k, v, net._KEEP, net.Work(), False)[-1]
    assert mixed[0] == pytest.approx(np.cumsum(v[0], axis=0) / np.arange(1, net.WINDOW + 1)[:, None], rel=1e-2)
