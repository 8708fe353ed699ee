"""Token windows keep their places in the text, with white-space tokens and with a public vocabulary's byte pairs."""

import os
import random

import pytest

from recollect.operators import text

#: Where public vocabularies lie, and the split that goes with this one.
VOCABULARY = os.environ.get("BYTE_PAIRS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def texts(seed=1):
    r = random.Random(seed)
    some = ["word", "Ärger", "日本語", "🙂", "x", "  ", "\n\n", "\t", "don't"]
    return [None, "", " \n ", "one", "日本語🙂", " lead and trail \n", *("".join(r.choices(some, k=r.randrange(1, 60))) + " " + " ".join(r.choices(some, k=9)) for _ in range(60))]


@pytest.mark.parametrize("size, overlap", [(4, 1), (5, 0), (3, 2), (100, 20)])
def test_word_windows(spark, size, overlap):
    rows = list(enumerate(texts()))
    got = text.token_windows(spark.createDataFrame(rows, "id long, text string"), size, overlap).collect()
    by = {}
    for g in sorted(got, key=lambda g: (g.id, g.chunk_index)):
        assert rows[g.id][1][g.char_start : g.char_end] == g.chunk and len(g.chunk.split()) == g.n_tokens
        by.setdefault(g.id, []).append(g.chunk.split())
    for i, t in rows:
        words = (t or "").replace("\x0b", "").split()
        want = [words[k : k + size] for k in range(0, max(1, len(words) - overlap), size - overlap)] if words else []
        assert by.get(i, []) == want
    for bad in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            text.token_windows(spark.createDataFrame(rows, "id long, text string"), *bad)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_byte_pair_windows_cover_the_text(spark):
    rows = list(enumerate(texts(2)))
    spans = text.byte_pair_spans(VOCABULARY, PATTERN)
    got = text.token_windows(spark.createDataFrame(rows, "id long, text string"), 6, 0, spans).collect()
    whole = {}
    for g in sorted(got, key=lambda g: (g.id, g.chunk_index)):
        assert rows[g.id][1][g.char_start : g.char_end] == g.chunk and 1 <= g.n_tokens <= 6
        end = whole.get(g.id, (0, 0))[1]
        assert g.char_start in (end, end - 1)  # a code point that is cut belongs to both
        whole[g.id] = (0, g.char_end)
    assert {i for i, t in rows if t and t.strip()} == set(whole) and all(e == len(rows[i][1]) for i, (_, e) in whole.items())
    starts, ends = spans("hello world")
    assert list(zip(starts, ends, strict=True)) == [(0, 5), (5, 11)]
