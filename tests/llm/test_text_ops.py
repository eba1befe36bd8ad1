"""Operators on documents against brute force on small fixtures, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import bpe, suffix_dedup
from flowsentry.llm.blocks import SubstringHash, text_blocks
from flowsentry.llm.exact_dedup import exact_duplicates
from flowsentry.llm.near_dedup import near_duplicates
from flowsentry.llm.packing import best_fit_decreasing, pack_documents, unpack_documents
from flowsentry.llm.pii import personal_data
from flowsentry.llm.queries import vocabulary_path

WORDS = "the of and a in to is on that by with from tion ment able".split()


def frame(spark, rows):
    """(doc_id, text) rows with other columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], "doc_id long, text string, kept string, _key int, class string, seg int, _text string")


def prose(rnd, n):
    return " ".join("".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 3))) for _ in range(n))


EDGES = [(None, None), (None, "same words here " * 20), (1, ""), (2, None), (3, "  \n\t"), (4, "same words here " * 20), (4, "same words here " * 20), (5, "a" * 30000), (6, "é🙂 " * 200), (7, "tie"), (8, "tie"), (9, "t ie")]


def hexed(data):
    return hashlib.sha256(data).hexdigest()


def brute_repeats(rows):
    ids = {}
    for i, t in rows:
        b, i = (t or "").encode(), suffix_dedup.NO_ID if i is None else i
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            ids[w] = min(ids.get(w, i), i)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), suffix_dedup.NO_ID if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if ids[b[k : k + 50]] < own:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hexed(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def repeats(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()), key=str)


def test_suffix_dedup(spark):
    rnd = random.Random(1)
    passage = prose(rnd, 60)
    rows = [(i, prose(rnd, 80) + (passage if i % 3 == 0 else "") + prose(rnd, 20)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200 + i, rows[i][1][: 200 + i] + "X" + rows[i][1][200 + i :]) for i in range(8)] + [(300, "ab" * 4000), (301, "ab" * 300), (302, "b" * 49), (303, "b" * 50), (304, "b" * 51)]
    assert repeats(frame(spark, rows).repartition(7)) == brute_repeats(rows)
    assert repeats(frame(spark, EDGES)) == brute_repeats(EDGES)
    assert repeats(frame(spark, [])) == []


@pytest.mark.parametrize("letters", [1, 2, 5, 200])
def test_two_stage_suffix_array(letters):
    text = np.random.default_rng(letters).integers(0, letters, 700).astype(np.uint8)
    raw = text.tobytes()
    order = suffix_dedup.suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(raw)))
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(len(raw)))
    prefixes = suffix_dedup.adjacent_prefixes(text, order)
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1] :][:50], raw[order[k] :][:50]
        assert prefixes[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_personal_data(spark):
    rnd = random.Random(2)
    parts = ["1", "12", "255", "256", ".", "-", " ", "a", "a@b.c", "@", "_d@e.f", "x@y", "+", "(", ")", "4111111111111111", "1.2.3.4", "é", "🙂", "\n", "+1 (555) 123-4567", "0000255.1.1.1", "%"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for i in range(800)]
    rows += [(900, "9" * 50000), (901, "a" * 100000), (902, "a@" * 10000), (903, "+1" + "(" * 50000), (904, "1.1." * 10000)] + EDGES
    got = personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(brute_spans(t))
    for r in got:
        digests = {hexed(",".join(f"{k}:{a}:{b}" for a, _, k, b in s).encode()): [sum(x[2] == k for x in s) for k in PATTERNS] for s in texts[r.doc_id]}
        assert digests[r.base_sha256] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert hexed(r.spans.encode()) == r.base_sha256 or r.n_found
    assert personal_data(frame(spark, [])).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"text here client ip: 10.0.0.{i} end") for i in range(30)] + [(50, "other client ip: 10x0x0x7777 done"), (51, "plain 77777777 stays")]
    got = {r.doc_id: r for r in personal_data(frame(spark, rows)).collect()}
    assert got[50].spans == "ip:17:28" and got[50].n_ip == 0 and got[50].n_found == 1
    assert got[51].spans == "" and got[7].spans == "ip:21:29" and got[7].n_found == 0


def test_contexts_of_whole_spans_discover_emails_cards_and_phones(spark):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "6011 0000 0000 0004"]
    rows = [(i, f"write to mail: {'abcdefghij'[i % 10]}{'xyz'[i // 10]}@example.com now") for i in range(30)]
    rows += [(100 + i, f"paid by card no {cards[i % 4]} today") for i in range(30)]
    rows += [(200 + i, f"my phone: +1 ({i + 100}) 555-7713 here") for i in range(30)]
    rows += [(300, "write to mail: joe1234_at_host now"), (301, "paid by card no 4111 1111 1111 1112 today"), (302, "my phone: (017) 555-7713 here"), (303, "room (017) 555-7713 stays")]
    rows += [(400 + i, f"see line{i} 10.0.0.{i} end") for i in range(30)] + [(450, "see line7 10x0x0x7777 end")]
    got = {r.doc_id: r for r in personal_data(frame(spark, rows)).collect()}
    assert got[300].spans == "email:15:30" and got[301].spans == "card:16:35" and got[302].spans == "phone:10:24"
    assert got[450].spans == "ip:10:21" and got[303].spans == "" and all(got[i].n_found == 0 for i, _ in rows if i % 100 < 30 and i < 300)


def test_exact_duplicates(spark):
    rnd = random.Random(3)
    rows = EDGES + [(100 + i, rnd.choice(["ab c", "abc", "a b c", "abd", "x" * 100 + str(i % 3), "x" * 100])) for i in range(200)]
    got = exact_duplicates(frame(spark, rows), digest_all=True, bits=1 << 12).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((i, keep, len(groups[norm]), i == keep, hexed(norm.encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plain = exact_duplicates(frame(spark, rows)).where("group_size = 1").collect()
    assert len(plain) == sum(len(g) == 1 for g in groups.values())
    assert exact_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates(spark):
    rnd = random.Random(4)
    rows, family = [], {}

    def edit(text, share):
        return " ".join(w if rnd.random() > share else f"w{rnd.randint(0, 10**9)}" for w in text.split())

    passage = prose(rnd, 60)
    for f in range(25):
        base = prose(rnd, 200)
        for _ in range(rnd.randint(1, 4)):
            family[len(rows)] = f
            rows.append((len(rows), edit(base, 0.01)))
    rows += [(1000 + i, prose(rnd, 60) + " " + passage) for i in range(80)]  # a common passage is no near copy
    rows += [(2000 + i, edit(rows[0][1], 0.01)) for i in range(150)]  # a large family
    rows += [(3000, "one two"), (3001, "one  two"), (3002, None), (3003, "")]
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r for r in near_duplicates(frame(spark, rows)).collect()}
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i in sets}
    assert all(r.kept == (r.class_id == i) for i, r in got.items())


def test_near_duplicates_in_a_hot_family(spark):
    """A third of all rows are copies with two words edited: plain similarity 0.81 to the original, 0.65 or so to each other."""
    rnd = random.Random(14)
    base = prose(rnd, 100).split()
    rows = [(i, prose(rnd, 100)) for i in range(1000)]
    family = range(1000, 1500)
    for i in family:
        words = list(base)
        if i != 1250:
            a = rnd.randint(4, 40)
            for k in (a, rnd.randint(a + 5, 95)):
                words[k] = f"w{i}x{k}"
        rows.append((i, " ".join(words)))
    original = {tuple(base[k : k + 5]) for k in range(96)}
    for _, t in rows[1000:]:
        w = t.split()
        own = {tuple(w[k : k + 5]) for k in range(96)}
        assert own == original or 0.8 <= len(own & original) / len(own | original) <= 0.85
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert {i for i in family if got[i] != 1000} == set() and all(got[i] == i for i in range(1000))


def test_near_duplicate_edges(spark):
    got = near_duplicates(frame(spark, EDGES)).select("doc_id", "class_id", "kept").collect()
    want = [(None, None, True), (None, 4, False), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 7, False), (9, 9, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert near_duplicates(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    import public_tokenizers

    ranks = bpe.tokenizer(vocabulary_path()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(reference):
    rnd = random.Random(5)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "\n", "\t", "a", "B", "é", "9", "½", "!", ".", "　", "日本", "🙂", "\x1c", "\x85", "'s", " '", "don't", "#", "\x00", "x" * 90, "'l", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [None, "", "a" * 5000, "'", "ab" * 3000]
    tokens = bpe.tokenizer(vocabulary_path())
    for _ in range(2):  # cold and warm cache
        for block in text_blocks(pa.array(texts), block_bytes=20000):
            ids, counts = tokens.encode_block(block)
            ends = np.cumsum(counts)
            for k in range(len(block)):
                assert ids[ends[k] - counts[k] : ends[k]].tolist() == reference.encode_ordinary(texts[block.first + k] or "")
            assert tokens.decode(ids).tobytes() == block.data.tobytes()


def test_bpe_documents(spark, reference):
    path = vocabulary_path()
    df = frame(spark, EDGES)
    want = sorted(((i, len(ids := reference.encode_ordinary(t or "")), hexed(" ".join(map(str, ids)).encode()), hexed((t or "").encode())) for i, t in EDGES), key=str)
    assert sorted((tuple(r) for r in bpe.round_trip(df, path).collect()), key=str) == want
    encoded = bpe.encode_documents(df, path)
    assert sorted(((r.doc_id, r.text) for r in bpe.decode_documents(encoded, path).collect()), key=str) == sorted(((i, t or "") for i, t in EDGES), key=str)
    assert bpe.round_trip(frame(spark, []), path).count() == 0


def test_packing_is_lossless(spark, reference):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, rnd.choice([0, 1, 5, 50, 700]))) for i in range(120)] + [(None, "no id " * 9), (500, None)]
    packed = pack_documents(frame(spark, rows), vocabulary_path(), row_tokens=128)
    got = packed.collect()
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128
        assert len(r.doc_ids) == len(r.doc_offsets) == len(r.cu_seqlens) - 1
        assert positions[: r.n_tokens].tolist() == [k for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for k in range(b - a)]
        assert (ids[r.n_tokens :] == 50256).all()
    back = sorted(((r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in unpack_documents(packed).collect()), key=str)
    assert back == sorted(((i, ids) for i, t in rows if (ids := reference.encode_ordinary(t or ""))), key=str)
    assert pack_documents(frame(spark, []), vocabulary_path()).count() == 0


def test_packing_spreads_equal_rows_and_checks_the_vocabulary(spark, monkeypatch, tmp_path):
    """A third of the rows are one row without an id: they come back as often, and no block holds most of them."""
    from flowsentry.llm import packing

    monkeypatch.setattr(packing, "BLOCK_TEXT_BYTES", 1 << 15)
    rows = [(None, "one and the same text " * 3)] * 4000 + [(i, f"text number {i} of many") for i in range(8000)]
    random.Random(3).shuffle(rows)
    packed = pack_documents(frame(spark, rows).repartition(40), vocabulary_path(), row_tokens=256).cache()
    counts = {r.doc_id: r["count"] for r in unpack_documents(packed).groupBy("doc_id").count().collect()}
    assert counts == {None: 4000, **{i: 1 for i in range(8000)}}
    held = [r.n for r in packed.select("block", F.explode("doc_ids").alias("id")).where("id is null").groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(held) < 1500 and len(held) > 5
    packed.unpersist()
    (tmp_path / "wide.tiktoken").write_text("YQ== 0\nYg== 70000\n")
    with pytest.raises(ValueError, match="padding"):
        pack_documents(frame(spark, rows[:2]), str(tmp_path / "wide.tiktoken"))


def test_best_fit_takes_the_fullest_row_with_room():
    lengths = np.random.default_rng(7).integers(1, 65, 500)
    rows = best_fit_decreasing(lengths, 64)
    assert sorted(i for r in rows for i in r) == list(range(500))
    room, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(c, k) for k, c in enumerate(room) if c >= lengths[i]]
        if fits:
            least = min(fits)[0]
            k = max(k for c, k in fits if c == least)
            room[k] -= lengths[i]
        else:
            room.append(64 - lengths[i])
        want.append(sorted(room))
    assert len(rows) == len(room)
    assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def test_substring_hash_depends_on_content_only():
    data = np.frombuffer(b"abcdefgh" * 40, dtype=np.uint8)
    h = SubstringHash(data)
    assert len(set(h(np.arange(0, 300, 8), np.arange(0, 300, 8) + 9).tolist())) == 1
    assert len(set(h.windows(5).tolist())) == 8
