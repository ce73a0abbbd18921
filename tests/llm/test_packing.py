import duckdb
import numpy as np
import pytest

from tessella.llm import packing
from tessella.llm.packing import Encoder, default_tokenizer, plan

TEXTS = [
    "", " ", "a", "Hello, World. it's 12 3/4 don't...", "straße ÉÈ Ünïcode ñandú", "é combining", "日本語 text", "<|endoftext|> x",
    "tab\tand\r\nnew\x0bline\x85x y", "ΑΣ Σ ΟΔΥΣΣΕΥΣ.", "İstanbul ǅ", "x" * 5000, "a,b.c.,d ,. ..", "%%%The*** &&&", "ʰx ªº",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer())


def test_ids_equal_the_tokenizers_own(encoder):
    rows = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    texts = TEXTS + [r[0] for r in rows]
    for _ in range(2):  # once new, once from the table
        found = encoder.encode(texts)
        for text, data in zip(texts, found, strict=True):
            assert np.frombuffer(data, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_full_tables_are_kept_as_the_older_ones(monkeypatch, encoder):
    monkeypatch.setattr(packing, "CACHED_BYTES", 600)
    small = Encoder(default_tokenizer())
    for texts in (["one Two, three four. five"], ["two three"], ["five One"], ["Two, six"], ["", " "], ["one Two, three four. five"]):
        assert small.encode(texts) == encoder.encode(texts)


class Counted:
    """A tokenizer that keeps what it was asked for."""

    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.inner.encode_batch_fast(texts, **options)


def test_words_that_differ_in_case_and_marks_are_encoded_by_their_parts_once(encoder):
    fresh = Encoder(default_tokenizer())
    fresh.tokenizer, fresh.words = Counted(fresh.tokenizer), Counted(fresh.words)
    texts = ["Éclair éclair. ÉCLAIR!! the*** The%%% (the) a|b,c 12 x21", "The éclair, the.", "", None]
    for _ in range(2):
        assert fresh.encode(texts) == encoder.encode(texts)
        assert fresh.tokenizer.asked == []
        parts = " ".join(fresh.words.asked).split()
        assert len(parts) == len(set(parts)) == len("éclair the a b c x 1 2 . , ( ) | !! *** %%%".split())


@pytest.mark.parametrize("shape", ["{}", "a{}b", "1{}", "{}2", ".{}!", "{}'s", "É{}", "<{}", "{}|>", "a {} b"])
def test_every_character_is_what_the_tokenizer_makes_of_it(encoder, shape):
    texts = [shape.format(chr(c)) for c in range(0x600)]
    want = [x.ids for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_the_table_stays_small(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_BYTES", 20_000)
    small = Encoder(default_tokenizer())
    letters = str.maketrans("0123456789", "abcdefghij")
    for k in range(40):
        text = " ".join(str(x).translate(letters) for x in range(k * 100 + 10_000, k * 100 + 10_100))
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids
        assert small.known.nbytes + small.ids.nbytes + small.bounds.nbytes < 30_000


def test_plan_places_everything_and_is_close_to_the_least():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, (rng.pareto(1.1, 20_000) * 60 + 1).astype(int))
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    seen: dict[int, int] = {}
    for n, own in plan(histogram):
        assert sum(own) <= 4096
        for x in own:
            seen[x] = seen.get(x, 0) + n
    assert seen == histogram
    assert sum(n for n, _ in plan(histogram)) <= 1.01 * -(-lengths.sum() // 4096) + 1


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {1: 10_000}, {2049: 7}, {1366: 9, 1365: 9}])
def test_plans_of_few_lengths(histogram):
    seen: dict[int, int] = {}
    for n, own in plan(histogram):
        assert sum(own) <= 4096
        for x in own:
            seen[x] = seen.get(x, 0) + n
    assert seen == histogram


def test_all_pieces_have_places(spark, edge_dir):
    import zlib

    from tessella.llm.packing import op4_pattern_packing
    from tests.llm.conftest import edge_rows

    rows = op4_pattern_packing(spark, edge_dir).collect()
    tokenizer = Encoder(default_tokenizer()).tokenizer
    want = []
    for doc, text, *_ in edge_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(doc, k, k * 4096, len(ids[k * 4096 : (k + 1) * 4096]), zlib.crc32(np.array(ids[k * 4096 : (k + 1) * 4096], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_no_rows(spark, empty_dir):
    from tessella.llm.packing import op4_pattern_packing

    assert op4_pattern_packing(spark, empty_dir).collect() == []
