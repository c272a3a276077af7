"""Three limits at once, and ids that equal the tokenizer's."""

import collections
import random

import numpy as np
import pytest

from checkframe.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def item(key, tokens, silent):
    return packing.Item(key, np.arange(tokens), 0, silent, tokens)


def first_fit(demands, limits):
    """Sequences of whole items by first fit, in the given order."""
    open_ = []
    for tokens, loss in demands:
        for room in open_:
            if room[0] >= tokens and room[1] >= loss and room[2]:
                break
        else:
            open_.append(room := [limits.tokens, limits.loss, limits.segments])
        room[0] -= tokens
        room[1] -= loss
        room[2] -= 1
    return len(open_)


def test_dot_product_beats_first_fit():
    rng = random.Random(1)
    limits = packing.Limits(100, 12, 60)
    demands = [(n, n - int(n * rng.choice([0, 0.2, 0.9]))) for n in (rng.randint(3, 60) for _ in range(400))]
    packed = packing.pack([item(k, n, n - loss) for k, (n, loss) in enumerate(demands)], limits)
    least = max(sum(n for n, _ in demands) / 100, sum(x for _, x in demands) / 60, len(demands) / 12)
    assert least <= len(packed) <= 1.05 * least < 1.1 * least < first_fit(demands, limits)
    got = collections.defaultdict(list)
    for sequence in packed:
        assert sum(len(x.ids) for x in sequence) <= 100 and sum(x.loss(len(x.ids)) for x in sequence) <= 60 and len(sequence) <= 12
        for x in sequence:
            got[x.key].append(x)
    for k, (n, _) in enumerate(demands):
        assert sorted(i for x in got[k] for i in x.ids) == list(range(n))


@pytest.mark.parametrize("which", range(3))
def test_each_limit_binds(which):
    """Items that use up one limit leave room under the others."""
    limits = packing.Limits(100, 5, 60)
    items = [[item(k, 30, 25) for k in range(40)], [item(k, 4, 2) for k in range(40)], [item(k, 30, 0) for k in range(40)]][which]
    full = packing.pack(items, limits)[:-1]
    use = {(sum(len(x.ids) for x in s), len(s), sum(x.loss(len(x.ids)) for x in s)) for s in full}
    assert {u[which] for u in use} == {(100, 5, 60)[which]}


def test_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer, ids_of, rng = Tokenizer.from_file(TOKENIZER), packing.word_ids(TOKENIZER), random.Random(1)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    parts = [*added, *(a.upper() for a in added), *(a.title() for a in added), "it", "It'S", "\u00c0\u00c9", "e\u0301", "\u0130stanbul", "\u017f", "\u65e5\u672c", "12a3", "!!!", "\u00a0", "\x1c", "a.b", "<|", "|>", "endoftext", "\x85", "don't", "\x00", "x" * 250]
    for _ in range(4000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "", "\n", "\t "]) for _ in range(rng.randint(1, 6)))
        raw = text.encode()
        got, _ = ids_of.documents(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), None)
        assert list(got) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_first_lines_bear_no_loss(spark):
    texts = ["a title\nand a body", "one line only", "a title\n  \n", None, "", "\nbody after an empty line", "<|endoftext|> x\ny"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, loss_tokens int")
    pieces = packing.pack_documents(frame, TOKENIZER, first_line_prompt=True).collect()
    ids = collections.Counter()
    for p in pieces:
        ids[p.doc_id] += p.length - p.loss_tokens
    assert [ids[i] for i in range(len(texts))] == [2, 0, 0, 0, 0, 0, 2]


def test_only_distinct_pieces_are_spelled(monkeypatch):
    """A word with marks shares its letters' ids with the bare word, and a slice asks for each piece once."""
    ids_of, asked = packing.WordIds(TOKENIZER), []
    learn = ids_of.learn
    monkeypatch.setattr(ids_of, "learn", lambda new: (asked.extend(new), learn(new)))
    raw = b"Word word, word. word!! (word) \xc3\x89t\xc3\xa9 \xc3\x89t\xc3\xa9, a1 a1"
    ids_of.documents(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), None)
    assert sorted(asked) == sorted([b"word", b",", b".", b"!!", b"(word)", b"a1", b"\xc3\x89t\xc3\xa9", b""])


def test_memory_of_pieces_is_bounded(monkeypatch):
    """Pieces that only one slice had are forgotten; those that came back stay, with the same ids."""
    monkeypatch.setattr(packing, "CACHE_PIECES", 64)
    ids_of, rng = packing.WordIds(TOKENIZER), random.Random(2)
    fresh = packing.WordIds(TOKENIZER)
    for turn in range(12):
        raw = " ".join(["often", *("".join(rng.choice("abcdeif") for _ in range(9)) for _ in range(30)), "often."]).encode()
        data, offsets = np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])
        assert (ids_of.documents(data, offsets, 1)[0] == fresh.documents(data, offsets, 1)[0]).all()
        assert len(ids_of.place) <= 64 + 33 and len(ids_of.place) == len(ids_of.size) == len(ids_of.again)
        assert turn < 2 or ids_of.place[b"often"] <= 32


def test_first_lines_take_no_second_spelling(spark, monkeypatch):
    """A slice is spelled once: the ids of first lines are counted among those of the texts."""
    ids_of, calls = packing.WordIds(TOKENIZER), []
    spell = ids_of.spell
    monkeypatch.setattr(ids_of, "spell", lambda words: (calls.append(len(words)), spell(words))[1])
    texts = [b"a longer title\nand a body", b"one line only", b"a title\n  \n", b"", b"  \xc3\x89t\xc3\xa9, a1\nx\ny"]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    words = ids_of.with_words(data, offsets, 1)[2]
    got = ids_of.first_lines(data, offsets, words)
    assert len(calls) == 1
    want = [len(ids_of.plain.encode(t, add_special_tokens=False).ids) for t in ("a longer title", "", "", "", "été, a1")]
    assert list(got) == want
