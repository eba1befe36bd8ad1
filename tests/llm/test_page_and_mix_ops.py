"""Pages, quality cutoffs, mixing and the pipeline against brute force on small fixtures."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from flowsentry.llm import quality, url_filter, warc
from flowsentry.llm.mixing import leaf_budgets, mix_sources


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, rule string")


# URL filter --------------------------------------------------------------------------------------


def brute_verdicts(rows):
    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
        path = rest[cut:]
        end = min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))
        return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]

    judged = []
    for page, url, html in rows:
        host, path = parts(url)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        judged.append((page, host, path, max(fits, key=lambda r: len(r.name)) if fits else None, html))
    import re

    hosts = sorted({j[1] for j in judged} - {""})
    links = {}
    for _, host, _, _, html in judged:
        for dst in {x.lower() for x in re.findall(r"href=\"(?:https?:)?//([^/?#\"]+)", html or "")}:
            if host and dst != host:
                links[host, dst] = links.get((host, dst), 0) + 1
    ranks = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        n = {h: sum(j[1] == h for j in judged) for h in hosts}
        seeds = {h: k / n[h] for h in hosts if (k := sum(j[1] == h and j[3] is not None and j[3].verdict == verdict for j in judged)) > 0}
        total = sum(seeds.values())
        edges = links if kind == "trust" else {(b, a): w for (a, b), w in links.items()}
        out = {}
        for (a, _), w in edges.items():
            out[a] = out.get(a, 0) + w
        rank = {h: 0.15 * k / total for h, k in seeds.items()}
        start = dict(rank)
        for _ in range(200):
            new = dict(start)
            for (a, b), w in edges.items():
                new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * w / out[a]
            rank = new
        ranks[kind] = rank
    result = []
    for page, host, path, rule, _ in judged:
        t, d = ranks["trust"].get(host, 0), ranks["distrust"].get(host, 0)
        method = "block" if d > t and d > 0.5 / max(1, len(hosts)) else "allow"
        result.append((page, host, path, rule.name if rule else None, rule.verdict if rule else method))
    return sorted(result, key=str)


def test_url_filter(spark):
    rnd = random.Random(1)
    hosts = ["a.example.com", "b.example.com", "c.example.org", "bad.net", "x.example.net", "NET", "worse.net", "farm.example.com", "d.org", "notnet"]
    rows = []
    for i in range(300):
        host = rnd.choice(hosts)
        path = rnd.choice(["/en/1", "/de/2", "/fr/3", "", "/en", "/"]) if host not in ("bad.net", "worse.net") else "/p"
        # farm links to the blocked hosts, good hosts link to each other
        targets = ["bad.net", "worse.net"] if host == "farm.example.com" else rnd.sample(["c.example.org", "d.org", "a.example.com"], 2)
        html = "".join(f'<a href="{rnd.choice(["http:", "https:", ""])}//{t.upper() if rnd.random() < 0.2 else t}/x">t</a>' for t in targets) + '<a href="/local">l</a>'
        rows.append((i, f"http://{host.title() if rnd.random() < 0.3 else host}{path}?q=1#f", html))
    rows += [(1000, None, None), (1001, "no scheme", "x"), (1002, "http://", ""), (1003, "ftp://a.net?x/", None), (1003, "ftp://a.net?x/", None), (None, "http://u:p@Example.COM/de/#", "")]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages(spark, rows)).collect()), key=str)
    assert got == brute_verdicts(rows)
    assert any(g[1] == "farm.example.com" and g[3] is None and g[4] == "block" for g in got)
    assert url_filter.judge_urls(pages(spark, [])).count() == 0


def test_hosts_with_few_judged_pages_seed_by_their_share(spark):
    """A tenth of a host's pages are blocked, nothing else is: distrust starts there and reaches the host that links to it."""
    link = '<a href="http://mixed.example.com/">m</a>'
    rows = [(i, f"http://mixed.example.com/{'de' if i == 0 else 'en'}/{i}", "") for i in range(10)]
    rows += [(20, "http://farm.example/", link), (21, "http://c.org/fr/1", ""), (22, "http://c.org/x", ""), (23, "http://far.example/", None)]
    got = {r.page_id: r for r in url_filter.judge_urls(pages(spark, rows)).collect()}
    assert [got[i].verdict for i in (0, 20, 21, 22, 23)] == ["block", "block", "allow", "allow", "allow"]
    assert got[20].distrust == pytest.approx(0.15 * 0.85) and got[1].distrust == pytest.approx(0.15) and got[22].trust == pytest.approx(0.15) and got[23].distrust == 0
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.values()), key=str) == brute_verdicts(rows)


# WARC ---------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rnd = random.Random(2)
    rows = [(i, f"http://h/{i}\r\n", rnd.choice(["", "same", f"<p>é{i}</p>" * rnd.randint(1, 500), None])) for i in range(200)]
    rows += [(7, "u", "same"), (7, "u", "same"), (None, "n", "same"), (None, None, "only without id"), (900, "u", "z" * 3_000_000)]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        refers = first.get(h or "")
        refers = refers if refers != i else None
        want.append((i, len(b), warc.payload_digest(b), "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, warc.archive_and_read(pages(spark, rows)).collect()), key=str) == sorted(want, key=str)
    big = warc.archive_and_read(pages(spark, rows), min_bytes=5).collect()
    assert all(r.record_type == "response" for r in big if r.payload_bytes < 5)
    assert warc.archive_and_read(pages(spark, [])).count() == 0


def record(i, payload):
    return warc.build_record(i, "u", payload, len(payload), warc.payload_digest(payload))


def foreign(kind, record_id, block, *fields):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + record_id, b"WARC-Date: 2024-01-01T00:00:00Z", *fields, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives_from_files(spark, tmp_path):
    """Any record type and id, skippable frames anywhere, hexadecimal digests, no dictionary."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    body = http.partition(b"\r\n\r\n")[2]
    is_http, sha = b"Content-Type: application/http; msgtype=response", hashlib.sha1(body).hexdigest().encode()
    records = [
        foreign(b"warcinfo", b"<urn:uuid:1>", b"software: x\r\n", b"Content-Type: application/warc-fields"),
        foreign(b"request", b"<urn:uuid:2>", b"GET / HTTP/1.1\r\n\r\n", b"Content-Type: application/http; msgtype=request"),
        foreign(b"response", b"<urn:uuid:3>", http, is_http, b"WARC-Payload-Digest: sha1:" + sha, b"WARC-Target-URI: http://a.example/?q=1:2"),
        foreign(b"revisit", b"<urn:uuid:4>", b"HTTP/1.1 304 Not Modified\r\n\r\n", is_http, b"WARC-Refers-To: <urn:uuid:3>", b"WARC-Payload-Digest: sha1:" + sha),
        foreign(b"resource", b"<urn:uuid:5>", b"", b"Content-Type: text/plain"),
    ]
    skip, pack = struct.pack("<II", 0x184D2A50, 3) + b"abc", zstandard.ZstdCompressor().compress
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.warc.zst").write_bytes(skip + skip.join(map(pack, records)) + skip)
    (tmp_path / "empty.warc.zst").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no archive")
    archives = warc.load_archives(spark, str(tmp_path))
    got = warc.read_records(archives).orderBy("place").collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "revisit", "resource"]
    assert [bytes(r.payload) for r in got] == [b"software: x\r\n", b"", body, b"", b""] and got[2].target_uri == "http://a.example/?q=1:2"
    assert got[3].refers_to == "<urn:uuid:3>" and got[2].headers["warc-date"] == "2024-01-01T00:00:00Z" and got[4].target_uri is None
    pages_read = {(r.record_type, r.page_id, r.payload_bytes) for r in warc.read_archives(archives).collect()}
    assert pages_read == {("response", None, len(body)), ("revisit", None, None)}
    for broken in (skip[:-1], pack(records[2].replace(b"hello", b"jello"))):
        with pytest.raises(warc.BadArchive):
            for headers, block in warc.open_archive(pack(records[0]) + broken):
                warc.read_payload(headers, block)


def test_archive_files_name_every_record_once(spark, tmp_path):
    """Repeated rows, repeated ids with other payloads and rows without an id, written as files and read back."""
    rows = [(1, "u", "same")] * 3 + [(1, "u", "other"), (2, "v", "same"), (None, "w", "same"), (None, "w", None), (None, "w", None), (3, None, "x" * 5000)]
    frame = pages(spark, rows).repartition(3)
    made = warc.save_archives(warc.write_archives(frame), str(tmp_path / "out")).collect()
    assert made and all(r.path.endswith(".warc.zst") for r in made) and sum(r.bytes for r in made) == sum(f.stat().st_size for f in (tmp_path / "out").iterdir())
    archives = warc.load_archives(spark, str(tmp_path / "out"))
    names = [r.record_id for r in warc.read_records(archives).collect()]
    assert len(names) == len(set(names)) == len(rows) and {"<urn:page:2>", "<urn:page:3>"} <= set(names)
    assert sorted(map(tuple, warc.read_archives(archives).collect()), key=str) == sorted(map(tuple, warc.archive_and_read(frame).collect()), key=str)
    assert warc.save_archives(warc.write_archives(pages(spark, [])), str(tmp_path / "none")).count() == 0


def test_archives_carry_a_dictionary_and_one_frame_per_record():
    records = [record(i, b"<p>hello %d</p>" % i * 800) for i in range(60)]
    archive = warc.seal_archive(records)
    assert struct.unpack_from("<I", archive)[0] == warc.DICTIONARY_MAGIC
    assert [h["warc-record-id"] for h, _ in warc.open_archive(archive)] == [f"<urn:page:{i}>" for i in range(60)]
    assert len(list(warc.open_archive(warc.seal_archive(records[:2])))) == 2 and list(warc.open_archive(b"")) == []


@pytest.mark.parametrize("broken", ["tail", "half", "no dictionary", "text", "length", "digest", "header"])
def test_broken_archives_are_refused(broken):
    records = [record(i, b"<p>hello %d</p>" % i * 800) for i in range(60)]
    good = records[0]
    archive = warc.seal_archive(records)
    data = {
        "tail": archive[:-1], "half": archive[: len(archive) // 2], "no dictionary": archive[8:], "text": b"abcdefghijkl",
        "length": warc.seal_archive([good.replace(b"\r\n\r\n", b"\r\n\r\nx", 1)]), "digest": warc.seal_archive([good.replace(b"hello", b"jello")]), "header": warc.seal_archive([good.replace(b"WARC-Date", b"WARC-Nope")]),
    }[broken]
    with pytest.raises(warc.BadArchive):
        for headers, block in warc.open_archive(data):
            warc.read_response(headers, block)


# Quality ------------------------------------------------------------------------------------------


def brute_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_text_statistics(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(["a", "b ", "c\n", " ", "\x0b", "é", "#", "|", "🙂", "\n\n", "a b c "]) for _ in range(rnd.randint(0, 60))), "en", "s", 1) for i in range(300)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1001, "", "en", "s", 0), (None, "a b c a b c", "xx", "s", 9), (1002, "ab " * 20000, "en", "s", 1)]
    got = quality.judge(docs(spark, rows), labels(spark, [])).collect()
    want = []
    for i, t, *_ in rows:
        s = brute_statistics(t) if i != 1002 else (20000, 40000, 0, 0, 20000)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((i, *s, failed, not failed))
    assert sorted(((*r[:8],) for r in got), key=str) == sorted(want, key=str)
    assert quality.judge(docs(spark, []), labels(spark, [])).count() == 0


@pytest.mark.parametrize(("rejected", "good", "alpha"), [(0, 100, 0.02), (1, 400, 0.01), (5, 1000, 0.02), (3, 50, 0.3)])
def test_binomial_tail(rejected, good, alpha):
    tail = sum(math.comb(good, k) * alpha**k * (1 - alpha) ** (good - k) for k in range(rejected + 1))
    assert quality.within_risk(rejected, good, alpha, tail * 1.0001)
    assert not quality.within_risk(rejected, good, alpha, tail * 0.9999)
    assert not quality.within_risk(0, 0, alpha, 1.0)


def test_cutoffs_are_certified_per_stratum(spark):
    rnd = random.Random(4)
    words = lambda: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(60))
    noisy = lambda: " ".join(f"w{rnd.randint(0, 10**6)}###" for _ in range(60))
    rows = [(i, noisy() if i % 5 == 0 else words(), "en", "s", 1) for i in range(3000)] + [(5000 + i, noisy() if i % 5 == 0 else words(), "rare", "s", 1) for i in range(40)]
    marks = [(i, int(i % 5 != 0), 0) for i, *_ in rows] + [(None, 1, 0), (3, None, 0)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows), labels(spark, marks)).collect()}
    assert all(got[i].kept == (i % 5 != 0) for i in range(3000))
    assert all(got[5000 + i].kept for i in range(40))  # too few labels there to certify a cutoff
    kept = quality.keep_documents(docs(spark, rows), labels(spark, marks))
    assert kept.columns == docs(spark, []).columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.kept}


def test_texts_without_words_meet_certified_cutoffs(spark):
    """Every ratio of such a text is undefined; it falls to the base rules and to no other."""
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{rnd.randint(0, 10**6)}{'###' if i % 5 == 0 else ''}" for _ in range(60)), "en", "s", 1) for i in range(3000)]
    marks = [(i, int(i % 5 != 0), 0) for i, *_ in rows]
    rows += [(9000, None, "en", "s", None), (9001, "", "en", "s", 0), (9002, " \n\t", "en", "s", 3)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows), labels(spark, marks)).collect()}
    assert got[0].failed_rules == ["symbols"] and len(got) == len(rows)
    assert all((got[i].n_words, got[i].base_failed, got[i].kept, got[i].failed_rules) == (0, True, False, []) for i in (9000, 9001, 9002))
    kept = quality.keep_documents(docs(spark, rows), labels(spark, marks))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.kept}


# Mixing -------------------------------------------------------------------------------------------


def fill(budget, children):
    """{name: share} of water filling over {name: (capacity, weight)}; shares floored."""
    open_, left, got = dict(children), budget, {}
    while True:
        total = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if w > 0 and left * w >= c * total]
        if not full:
            break
        k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k))
        got[k] = open_.pop(k)[0]
        left -= got[k]
    total = sum(w for _, w in open_.values())
    return got | {k: min(c, int(left * w / total)) if total else 0 for k, (c, w) in open_.items()}


def test_mixing(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        source = rnd.choice(["src0"] * 6 + ["src1", "src2", "src5", "web", None])
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 10, 100])), rnd.choice(["en", "en", "de", None]), source, 1))
    rows += [(3, rows[3][1], rows[3][2], rows[3][3], 1), (None, None, "en", "src1", 0)]
    weights = {"domain": {"family0": 1.0, "family1": 3.0}, "source": {"src5": 0.0}, "lang": {"de": 2.0}}
    got = mix_sources(docs(spark, rows), weights=weights, budget_share=0.6, max_epochs=2, seed=3).collect()
    assert len(got) == len(rows)

    def domain(s):
        return f"family{int(s[3:]) % 4}" if s.startswith("src") else "other"

    leaves = {}
    for i, t, lang, s, _ in rows:
        leaf = (domain(s or ""), lang or "", s or "")
        leaves.setdefault(leaf, []).append((i, len((t or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weigh = lambda level, k: weights[level].get(k, 1.0)
    top = fill(int(sum(tokens.values()) * 0.6), {d: (2 * sum(n for k, n in tokens.items() if k[0] == d), weigh("domain", d)) for d in {k[0] for k in tokens}})
    budget = {}
    for d, b in top.items():
        langs = fill(b, {x: (2 * sum(n for k, n in tokens.items() if k[:2] == (d, x)), weigh("lang", x)) for x in {k[1] for k in tokens if k[0] == d}})
        for x, c in langs.items():
            for s, n in fill(c, {k[2]: (2 * tokens[k], weigh("source", k[2])) for k in tokens if k[:2] == (d, x)}).items():
                budget[d, x, s] = n
    want = []
    for leaf, members in leaves.items():
        epochs = min(2, budget[leaf] // tokens[leaf]) if tokens[leaf] else 0
        need, ahead = budget[leaf] - epochs * tokens[leaf], 0
        order = {}
        for i, n in members:
            order.setdefault(hashlib.md5(f"3:{epochs}:{'' if i is None else i}".encode()).hexdigest(), []).append((i, n))
        for place in sorted(order):
            want += [(i, *leaf, n, budget[leaf], epochs + (ahead < need)) for i, n in order[place]]
            ahead += sum(n for _, n in order[place])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert mix_sources(docs(spark, [])).count() == 0


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)]
    got = {r.source: r.budget for r in leaf_budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), 400 / 3010, 1).collect()}
    assert got == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}


# Pipeline -----------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rnd = random.Random(6)
    words = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    rows = [(i, words(80), "en", f"src{i % 5}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " \n", "en", "src1", 1) for i in range(5)]  # exact copies, one blank longer
    rows += [(200 + i, rows[10 + i][1] + " more", "en", "src1", 1) for i in range(5)]  # near copies
    rows += [(300, "short", "en", "src0", 1), (301, None, "en", "src0", None), (302, "a b c " * 40, "en", "src0", 1)]  # fail the base rules
    rows += [(20, rows[20][1], "en", "src0", 1)]  # a repeated row
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(1, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs(spark, []).columns, name
        kept.append(sorted(r.doc_id for r in frame.select("doc_id").collect()))
    base = [r[0] for r in rows if r[0] < 300]
    assert kept[0] == sorted(base)
    exact = sorted([i for i in base if i not in range(5)])
    exact.remove(20)
    assert kept[1] == exact  # the longer copy stays
    assert kept[2] == [i for i in exact if not 200 <= i < 205]
    mixed = {r.doc_id: r.copies for r in mix_sources(docs(spark, [r for n, r in enumerate(rows) if r[0] in kept[2] and (r[0] != 20 or n == 20)])).collect()}
    assert kept[3] == sorted(i for i, n in mixed.items() for _ in range(n))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == kept[3] and all(len(r.ids) == 4 * r.n_tokens for r in out)
    assert np.frombuffer(out[0].ids, "<i4").min() >= 0


def test_pipeline_of_nothing(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_filters_keep_columns_of_rows_without_ids(spark, tmp_path):
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    text = " ".join(f"t{k}" for k in range(60))
    df = docs(spark, [(None, text, None, None, None), (None, text, None, None, None), (1, text + " x", "en", "s", 1)]).withColumn("again", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
    assert corpus_pipeline.exact_stage(spark, df, str(tmp_path)).count() == 2


def test_near_stage_keeps_a_text_whose_id_also_has_a_copy(spark, tmp_path):
    same, other = "the quick brown fox jumps over the lazy dog again and again " * 3, "nothing of this has been said before in any of the other texts here " * 3
    rows = [(3, same), (5, same), (5, other), (7, same), (7, same), (None, same)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(3, same), (5, same), (5, other), (None, same)], key=str)
