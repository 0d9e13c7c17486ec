"""Packing, token files, materialisation: exact round trips."""

import zlib

import numpy as np
import pytest

from quillmatch.llm import materialise, packing, store, token_counts, vectorfit
from quillmatch.llm.bytebpe import ByteChunks
from quillmatch.llm.tokens import ChunkTokenizer, default_path

TEXTS = [(1, "Hello world, this is a test."), (2, None), (3, ""), (None, "naïve café!! it's 3.14 <|endoftext|>"), (4, "lorem ipsum dolor " * 3000), (5, "twice"), (5, "twice"), (6, "日本語   \x1c x")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, start int, slot string").repartition(2, "doc_id")


def test_chunked_ids_are_the_tokenizers(tokenizer):
    import random

    rng, ours = random.Random(1), ChunkTokenizer(limit=50)
    letters = "aàÀßÿÖb.,!'9² \n\t \x1ćΣœŒ日<|$%"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(5000)]
    texts += ["a<|endoftext|>b", "A<|ENDOFTEXT|>.", "don't. WE'LL, x", "wait... what?!", "x" * 500]
    for t in texts:
        assert ours.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_places_every_token_once():
    import random

    rng = random.Random(2)
    for _ in range(50):
        lengths = [rng.choice([0, 1, 5, 17, 64, 200]) for _ in range(rng.randint(0, 40))]
        pieces = packing.pack(lengths, 64)
        for d, n in enumerate(lengths):
            own = sorted((s, k) for x, s, k, _, _ in pieces if x == d)
            assert sum(k for _, k in own) == n and [s for s, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))]
        rooms = packing.capacities(sum(lengths), 64)
        for s, room in enumerate(rooms):
            own = sorted((o, k) for _, _, k, x, o in pieces if x == s)
            assert sum(k for _, k in own) == room and [o for o, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))]
    # equal documents spread over the sequences
    costs = {}
    for _, _, k, s, _ in packing.pack([16] * 16, 64):
        costs[s] = costs.get(s, 0) + k
    assert set(costs.values()) == {64}


def test_pack_documents(spark, tokenizer):
    got = packing.pack_documents(documents(spark), length=64, group=200, with_ids=True).collect()
    ids = {}
    for d, t in TEXTS:
        ids.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for d, all_ids in ids.items():
        own = [r for r in got if r["doc_id"] == d]
        assert sum(r["length"] for r in own) == sum(map(len, all_ids))
        for r in own:
            piece = all_ids[0][r["start"] : r["start"] + r["length"]]
            assert r["ids"] == piece and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(all_ids[0])
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert total <= 64 and total & (total - 1) == 0
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_separator_scan_blocks():
    two, none = token_counts.scan_block(np.array([5, 9, 9, 7, 7], np.uint16), 9), token_counts.scan_block(np.array([5, 5], np.uint16), 9)
    assert (two[0], two[1].tolist(), two[2], none[0], none[1].tolist(), none[2]) == (2, [1, 0], 2, 0, [], 2)


@pytest.mark.parametrize("block", [2, 6, 10, 1 << 20])
def test_token_counts_across_blocks(spark, tmp_path, block):
    folder = f"file://{tmp_path}/tokens"
    store.make_dir(folder)
    rng = np.random.default_rng(3)
    expected = {}
    for f in range(3):
        lengths = rng.integers(0, 12, 20).tolist() if f else []
        rest = f * 3 if f else 0
        ids = [x for n in lengths for x in [7] * n + [token_counts.END]] + [7] * rest
        store.write_then_move(f"{folder}/part-{f}.tokens", [np.array(ids, "<u2").tobytes()])
        expected |= {(f"part-{f}.tokens", i): (n, True) for i, n in enumerate(lengths)}
        if rest:
            expected[f"part-{f}.tokens", len(lengths)] = (rest, False)
    got = {(r["file"], r["ordinal"]): (r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(spark, folder, block=block).collect()}
    assert got == expected


def test_token_counts_of_documents(spark, tmp_path, tokenizer):
    got = token_counts.count_document_tokens(documents(spark), f"file://{tmp_path}/t").collect()
    tokenizer.encode_special_tokens = True
    expected = sorted((str(d), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in TEXTS)
    tokenizer.encode_special_tokens = False
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == expected
    assert token_counts.count_document_tokens(documents(spark, []), f"file://{tmp_path}/none").count() == 0


def test_odd_file_is_an_error(spark, tmp_path):
    store.make_dir(f"file://{tmp_path}/o")
    store.write_then_move(f"file://{tmp_path}/o/x.tokens", [b"abc"])
    with pytest.raises(ValueError, match="whole number"):
        token_counts.count_tokens(spark, f"file://{tmp_path}/o")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    index = np.arange(n)
    slots = materialise.permute(index, n, key=9)
    assert sorted(slots) == index.tolist()
    assert (materialise.permute(slots, n, key=9, inverse=True) == index).all()
    if n >= 1000:
        assert (materialise.permute(index, n, key=10) != slots).any() and abs(np.corrcoef(index, slots)[0, 1]) < 0.1


def test_materialise_round_trip(spark, tmp_path, tokenizer):
    folder = f"file://{tmp_path}/shards"
    rows = materialise.materialise(documents(spark), folder, key=5, length=16, shard_sequences=10).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    read = list(materialise.read_from(folder))
    assert [s for s, _ in read] == list(range(len(rows)))
    assert all(zlib.crc32(x[: r["n_tokens"]].tobytes()) == r["ids_crc32"] for r, (_, x) in zip(rows, read, strict=True))
    resumed = list(materialise.read_from(folder, 13))
    assert [s for s, _ in resumed] == list(range(13, len(rows))) and (resumed[0][1] == read[13][1]).all()
    tokenizer.encode_special_tokens = True
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    tokenizer.encode_special_tokens = False
    assert sum(r["n_tokens"] for r in rows) == total
    in_order = sorted(rows, key=lambda r: r["sequence"])
    assert {d for r in in_order for d in r["doc_ids"]} == {d for d, _ in TEXTS}
    assert materialise.materialise(documents(spark, []), f"file://{tmp_path}/none", key=5).count() == 0
    assert list(materialise.read_from(f"file://{tmp_path}/none")) == []


def test_empty_documents_fill_shards(spark, tmp_path):
    """A corpus of empty texts is one id a document: sequences name them all, a batch at a time."""
    df = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN '' END AS text").coalesce(1)
    out = materialise.materialise(df, f"file://{tmp_path}/shards", key=5, length=64, shard_sequences=16).collect()
    assert sum(r["n_tokens"] for r in out) == 5000 and sorted(d for r in out for d in r["doc_ids"]) == list(range(5000))
    assert sorted(r["slot"] for r in out) == list(range(79))
    counts = token_counts.count_document_tokens(df, f"file://{tmp_path}/tokens").collect()
    assert len(counts) == 5000 and {r["n_tokens"] for r in counts} == {0}


def test_failed_writes_leave_no_file(tmp_path):
    with pytest.raises(RuntimeError), store.part_file(f"file://{tmp_path}/x.bin") as out:
        out.write(b"half")
        raise RuntimeError
    assert not (tmp_path / "x.bin").exists()


BYTES = [(1, "Hello world, this is a test."), (2, None), (3, ""), (None, "naïve café!! it's 3.14 <|endoftext|> x"), (4, "lorem ipsum dolor " * 3000), (5, "twice"), (5, "twice"), (6, "日本語   \x1c x"), (7, "a\n\nb  c \td, .e. f.g,h")]


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path("byte_bpe_50k.json"))


def test_byte_chunks_are_the_tokenizers(byte_tokenizer):
    import random

    rng = random.Random(3)
    white = "".join(map(chr, [0x85, 0xA0, 0x200B, 0x180E, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 11, 12, 0, 0x1C, 0x1D]))
    for letters in ("aAàÀßÿ.,!'s9² \n\t|\x85\xa0ab cd", "aàÀßÖb.,!'s9² \n\t\rćΣœ日<|$%" + white, "ab ., \n"):
        ours = ByteChunks(limit=50)
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 16)))
            assert ours.ids(t).tolist() == byte_tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    ours = ByteChunks()
    for t in ["a <|endoftext|> b", "a<|endoftext|>b  ", "don't we'll I'm x'sy", "'ll 'S", "x" * 500, "word. " * 50, None]:
        assert ours.ids(t).tolist() == byte_tokenizer.encode(t or "", add_special_tokens=False).ids


def test_best_fit_keeps_every_capacity():
    import random

    rng = random.Random(7)
    for rule in ("norm", "dot"):
        for _ in range(40):
            lengths = [rng.choice([1, 2, 5, 17, 40, 64]) for _ in range(rng.randint(0, 60))]
            room = vectorfit.Room(tokens=64, documents=rng.choice([3, 64]), cost=64**2 if rng.random() < 0.5 else 2000, rule=rule)
            lengths = [min(n, room.longest()) for n in lengths]
            of = vectorfit.best_fit(lengths, room)
            bins = {}
            for n, s in zip(lengths, of, strict=True):
                bins.setdefault(s, []).append(n)
            assert sorted(bins) == list(range(len(bins)))
            assert all(sum(b) <= 64 and len(b) <= room.documents and sum(n * n for n in b) <= room.capacity()[2] for b in bins.values())
            # no two sequences could be one
            items = sorted(bins.values(), key=sum)
            if len(items) > 1:
                both = items[0] + items[1]
                assert sum(both) > 64 or len(both) > room.documents or sum(n * n for n in both) > room.capacity()[2]
    assert max(vectorfit.best_fit([30, 30, 20, 20, 14, 14], vectorfit.Room(tokens=64))) == 2
    with pytest.raises(ValueError):
        vectorfit.Room(tokens=0).longest()
    assert vectorfit.Room(tokens=100, cost=99).longest() == 9


def test_cut_leaves_the_first_piece_shorter():
    for n in range(1, 40):
        pieces = vectorfit.cut(n, 8)
        assert sum(k for _, k in pieces) == n and all(k == 8 for _, k in pieces[1:]) and 1 <= pieces[0][1] <= 8
        assert [s for s, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))]


@pytest.mark.parametrize("group", [200, 1 << 21])
def test_vector_fit_documents(spark, byte_tokenizer, group):
    df = spark.createDataFrame([(*r, 0, "x") for r in BYTES * 3], "doc_id long, text string, piece int, offset string").repartition(2, "doc_id")
    got = vectorfit.pack_documents(df, vectorfit.Room(tokens=64), group=group, with_ids=True).collect()
    whole, bins = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        whole.setdefault((r["doc_id"], r["piece"]), []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for d, t in {r[0]: r[1] for r in BYTES}.items():
        copies = 3 * sum(x[0] == d for x in BYTES)
        ids = byte_tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = vectorfit.cut(len(ids), 64)
        for k, (start, n) in enumerate(pieces):
            rows = whole.pop((d, k))
            assert len(rows) == copies and all(r["start"] == start and r["ids"] == ids[start : start + n] for r in rows)
    assert not whole
    tokens = sum(r["length"] for r in got)
    assert len(bins) <= -(-tokens // 64) + 2
    assert vectorfit.pack_documents(df.limit(0)).count() == 0
