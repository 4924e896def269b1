"""URL filter, embeddings, WARC, mixing, sharding: queries against brute force, edges, invariants."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import common, embeddings, mixing, sharding, url_filter, warc
from tessella.llm.common import made, release

SF = "/root/testdata/sf0.001"


# -- url filter -------------------------------------------------------------------------------------------------------


def split_url(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://A.Example.com/en/7?x", "https://example.net/de/81#a", "ftp://example.net/de/9", "x.org/es/1", None, "", "http://", "http://org/es/", "http://notcom/en/", "https://h.com:80/en/1", "http://a.b.com?/en/", "http://Éx.com/en/é/😀", "http://u.org/es/" + "long" * 2000, "a://b://c/d", "http://z.net/fr/\n1"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x"), (None, URLS[1], "y")], "page_id long, url string, host string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r.page_id] if r.page_id is not None else URLS[1]
        host, path = split_url(url)
        assert (r.host, r.path) == (host, path)
        rule, verdict = rule_of(host, path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("page_id = 6")).collect()} == {"allow"}


def test_scores_are_the_smoothed_model(spark):
    examples = [("allow", f"http://a.net/de/{i}") for i in range(40)] + [("block", f"http://b.org/es/{i * 7}") for i in range(40)]
    pages = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(examples)] + [(900, "http://a.net/fr/1"), (901, "http://b.org/it/7")], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert got[900].verdict == "allow" and got[901].verdict == "block" and got[900].score > got[901].score
    held = {(r.host, r.path) for r in pages.select(url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path")).where(F.pmod(F.xxhash64("host", "path"), F.lit(url_filter.FOLDS)) == 0).collect()}
    k, counts, totals = url_filter.ORDER, {}, {}
    for v, u in examples:
        host, path = split_url(u)
        if (host, path) in held:
            continue
        chars = ["^"] * k + list(host + path) + ["$"]
        for i in range(k, len(chars)):
            for o in range(k + 1):
                gram, context = "".join(chars[i - o : i + 1]), "".join(chars[i - o : i])
                counts.setdefault(v, Counter())[gram, o] += 1
                totals.setdefault(v, Counter())[context, o] += 1

    def logp(v, chars, i):
        p = (counts[v][chars[i], 0] + 0.5) / (totals[v]["", 0] + 0.5 * url_filter.ALPHABET)
        for o in range(1, k + 1):
            p = (counts[v]["".join(chars[i - o : i + 1]), o] + url_filter.STRENGTH * p) / (totals[v]["".join(chars[i - o : i]), o] + url_filter.STRENGTH)
        return math.log(p)

    for page in (900, 901):
        chars = ["^"] * k + list(got[page].host + got[page].path) + ["$"]
        exact = [logp("allow", chars, i) - logp("block", chars, i) for i in range(k, len(chars))]
        assert got[page].score == pytest.approx(sum(exact) / len(exact), abs=1e-9)


def test_url_query_decides_every_page(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in url_filter.query(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, u in pages.items():
        assert (got[i].host, got[i].path) == split_url(u) and got[i].rule == rule_of(*split_url(u))[0]


@pytest.mark.parametrize("few", [3000, 1 << 20])
def test_scores_are_exact_whatever_the_number_of_ngrams(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", few, raising=False)
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), n))
    urls = ["http://" + ("a.net/de/", "b.org/es/", "c.info/fr/")[i % 3] + text(20) for i in range(9000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    split = pages.select("page_id", url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path"), F.pmod(F.xxhash64(url_filter.host(F.col("url")), url_filter.path(F.col("url"))), F.lit(url_filter.FOLDS)).alias("fold")).collect()
    k, counts, contexts = url_filter.ORDER, {v: Counter() for v in ("allow", "block")}, {v: Counter() for v in ("allow", "block")}
    for r in split:
        verdict = rule_of(r.host, r.path)[1]
        if verdict and r.fold:
            chars = "^" * k + r.host + r.path + "$"
            for i in range(k, len(chars)):
                for o in range(k + 1):
                    counts[verdict][chars[i - o : i + 1]] += 1
                    contexts[verdict][o, chars[i - o : i]] += 1

    def logp(v, chars, i):
        p = (counts[v][chars[i]] + 0.5) / (contexts[v][0, ""] + 0.5 * url_filter.ALPHABET)
        for o in range(1, k + 1):
            p = (counts[v][chars[i - o : i + 1]] + url_filter.STRENGTH * p) / (contexts[v][o, chars[i - o : i]] + url_filter.STRENGTH)
        return math.log(p)

    got = {r.page_id: r.score for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    for r in split:
        chars = "^" * k + r.host + r.path + "$"
        exact = [logp("allow", chars, i) - logp("block", chars, i) for i in range(k, len(chars))]
        assert got[r.page_id] == pytest.approx(sum(exact) / len(exact), abs=1e-9)


def verdicts_by_hand(rows):
    """rows (host, path, held) -> {(host, path): (score, verdict)}: the whole filter in plain Python, threshold included."""
    k, times = url_filter.ORDER, Counter((h, p) for h, p, _ in rows)
    held = {(h, p): x for h, p, x in rows}
    counts, contexts = ({v: Counter() for v in ("allow", "block")} for _ in range(2))
    for (h, p), n in times.items():
        v = rule_of(h, p)[1]
        if v and not held[h, p]:
            chars = "^" * k + h + p + "$"
            for i in range(k, len(chars)):
                for o in range(k + 1):
                    counts[v][chars[i - o : i + 1]] += n
                    contexts[v][o, chars[i - o : i]] += n

    def logp(v, chars, i):
        q = (counts[v][chars[i]] + 0.5) / (contexts[v][0, ""] + 0.5 * url_filter.ALPHABET)
        for o in range(1, k + 1):
            q = (counts[v][chars[i - o : i + 1]] + url_filter.STRENGTH * q) / (contexts[v][o, chars[i - o : i]] + url_filter.STRENGTH)
        return math.log(q)

    score = {}
    for h, p in times:
        chars = "^" * k + h + p + "$"
        score[h, p] = sum(logp("allow", chars, i) - logp("block", chars, i) for i in range(k, len(chars))) / (len(chars) - k)
    bins = {}
    for u, n in times.items():
        v = rule_of(*u)[1]
        if v and held[u]:
            b = max(-url_filter.BINS, min(url_filter.BINS, math.floor(score[u] * url_filter.BINS_PER_NAT)))
            bins.setdefault(b, Counter())[v] += n
    allowed, blocked, cut = sum(c["allow"] for c in bins.values()), sum(c["block"] for c in bins.values()), -math.inf
    if allowed and blocked:
        order, found = sorted(bins), []
        for i in range(len(order) + 1):
            low = order[i - 1] + 1 if i else -url_filter.BINS - 1
            at = max(low, min(order[i] if i < len(order) else order[-1] + 1, 0)) / url_filter.BINS_PER_NAT
            error = sum(bins[b]["allow"] for b in order[:i]) / allowed + 1 - sum(bins[b]["block"] for b in order[:i]) / blocked
            found.append((error, abs(at), at))
        cut = min(found)[2]
    return {u: (s, rule_of(*u)[1] or ("allow" if s >= cut else "block")) for u, s in score.items()}


@pytest.mark.parametrize("few", [100_000, 300])
def test_every_verdict_by_hand(spark, monkeypatch, few):
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", few)
    held = F.pmod(F.xxhash64("host", "path"), F.lit(url_filter.FOLDS)) == 0
    rows = spark.read.parquet(f"{SF}/pages.parquet").select(url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path")).select("host", "path", held.alias("held")).collect()
    want = verdicts_by_hand([tuple(r) for r in rows])
    got = url_filter.query(spark, SF).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} == {"allow", "block"}
    for r in got:
        score, verdict = want[r.host, r.path]
        assert r.score == pytest.approx(score, abs=1e-9) and r.verdict == verdict


# -- embeddings -------------------------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.95):
    scaled = lambda v: np.array(v, float) / np.abs(np.array(v, float)).max()  # noqa: E731  huge and tiny vectors have a cosine too
    ok = [(k, scaled(v)) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(ok):
        for b, y in ok[i + 1 :]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[a] += 1
                n[b] += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    return sorted(((i, n[k], least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("chunk", "fanout", "block", "numbers"), [(4096, 64, 16, 1 << 21), (40, 64, 2, 1 << 21), (9, 3, 3, 100)])
def test_links_against_brute_force(spark, monkeypatch, chunk, fanout, block, numbers):
    """One chunk; several chunks of one level; many levels of narrow cells, several passes and blocks."""
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "FANOUT", fanout)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PASS_NUMBERS", numbers)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 12))
    near = [c + rng.normal(size=12) * s for c in centres for s in (0.05, 0.1, 0.25, 0.3)]
    chain = [np.array([math.cos(a), math.sin(a)] + [0.0] * 10) for a in np.arange(0, 3, 0.25)]
    vectors = [*near, *chain, *rng.normal(size=(150, 12)), *[near[0]] * 30, 2 * near[0], np.zeros(12), near[1] * 1e-200, near[1] * 1e200]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, rows[5][1]), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x")).withColumn("vector", F.lit(1))
    left = made()
    got = sorted((tuple(r) for r in embeddings.dedup(df).collect()), key=str)
    assert got == brute_links(rows)
    release(spark, left)
    assert made() == left
    if chunk > 40:
        assert embeddings.dedup(df.limit(0)).count() == 0
        assert embeddings.dedup(df.where("vec_id in (900, 904)")).count() == 2


def test_groups_of_chunks_share_tasks_and_large_lookups_are_shuffled(spark, monkeypatch):
    """More groups than tasks, and no table of vectors or of groups small enough to broadcast: the same links."""
    monkeypatch.setattr(embeddings, "CHUNK", 8)
    monkeypatch.setattr(embeddings, "BLOCK", 2)
    monkeypatch.setattr(embeddings, "MEETING_TASKS", 3)
    monkeypatch.setattr(embeddings, "SENT_BYTES", 0)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 6))
    rows = [(i, [float(x) for x in c + rng.normal(size=6) * 0.15]) for i, c in enumerate(np.repeat(centres, 4, axis=0))]
    written, kept = embeddings.materialise, {}
    monkeypatch.setattr(embeddings, "materialise", lambda df, name: kept.setdefault(name, written(df, name)) if name in ("cover-groups", "cover-links") else written(df, name))
    got = sorted((tuple(r) for r in embeddings.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == brute_links(rows)
    assert kept["cover-groups"].count() > 3 and len(kept["cover-links"].inputFiles()) <= 3


# -- warc -------------------------------------------------------------------------------------------------------------

runs = st.lists(st.lists(st.tuples(st.sampled_from(["a", "b", "é", "z"]), st.sampled_from(["1", "2"]), st.none() | st.integers(0, 5)), max_size=8), max_size=9)


@settings(max_examples=150, deadline=None)
@given(runs)
def test_loser_tree_merges(found):
    ascending = [sorted(r, key=warc.order) for r in found]
    got = list(warc.loser_tree(ascending))
    assert [warc.order(e) for e in got] == sorted(warc.order(e) for r in found for e in r)


def test_round_trip_and_global_order(spark, tmp_path):
    rng = random.Random(6)
    bodies = ["", "same", "x" * 100_000, "é\r\n\r\nWARC/1.1\r\n", "😀"]
    rows = [(i, f"http://{rng.choice('abc')}.org/{i % 7}" if i % 5 else None, bodies[i % 9] if i % 9 < 5 else f"unique {i}", "x") for i in range(80)]
    rows += [(80, "http://e.org/\r\nX: y", None, "x"), (3, "http://b.org/", rows[3][2], "x"), (None, "HTTP://Q.Org/P", "same", "x"), (None, "u", "only null", "x"), (None, "u", "only null", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(5)
    folder = str(tmp_path / "warc")
    warc.write(pages, "file://" + folder)
    got = warc.index(spark, "file://" + folder).collect()
    first = {}
    for i, _, b, _ in rows:
        first[b or ""] = min((x for x in (first.get(b or ""), i) if x is not None), default=None)
    expected = []
    for i, _, b, _ in rows:
        data = (b or "").encode()
        revisit = first[b or ""] is not None and i != first[b or ""]
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[b or ""] if revisit else None))
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(expected, key=str)
    keys = [warc.order((r.urlkey, r.ts, r.id)) for r in got]
    assert keys == sorted(keys)
    r = next(x for x in got if x.id == 4)
    raw = gzip.open(next((tmp_path / "warc").glob(r.archive))).read()
    record = raw[r.offset : r.offset + r.length]
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith("😀".encode() + b"\r\n\r\n")
    warc.write(pages.limit(0), "file://" + folder + "0")
    assert warc.index(spark, "file://" + folder + "0").count() == 0


def test_smaller_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a.org", "tiny" if i < 3 else "long enough") for i in range(6)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w", min_bytes=5)
    assert [r.record_type for r in sorted(warc.index(spark, f"file://{tmp_path}/w").collect(), key=lambda r: r.id)] == ["response"] * 4 + ["revisit"] * 2


def test_damaged_archives_are_found():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    digest = base64.b32encode(hashlib.sha1(b"hi").digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: d\r\nWARC-Target-URI: http://a/\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    good = head + block + b"\r\n\r\n"
    assert len(warc.entries("a", gzip.compress(good * 3))) == 3
    for bad in (good.replace(b"hi\r\n\r\n", b"ho\r\n\r\n"), good[:-1], b"x" + good):
        with pytest.raises(ValueError):
            warc.entries("a", gzip.compress(bad))


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "CLASSES", (200, 2000, 10_000))
    rng = random.Random(6)
    pages = [(i, f"http://h/{i}", "".join(rng.choices("abc", k=rng.choice((0, 50, 1500, 9000, 50_000))))) for i in range(120)] + [(500, None, None), (501, "http://h/5", "x" * 3_000_000)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), f"file://{tmp_path}/b")
    largest = []
    for f in (tmp_path / "b").rglob("*.gz"):
        found = [len(block) for _, _, _, block in warc.parse(f.read_bytes())]
        largest.append(sum(found))
        assert len(found) == 1 or sum(found) <= 20_000 + 200 * len(found)
    got = {r.id: r for r in warc.index(spark, f"file://{tmp_path}/b").collect()}
    assert len(largest) > 10 and max(largest) > 3_000_000 and {i: got[i].payload_bytes for i in got} == {i: len(h or "") for i, _, h in pages}


# -- mixing -----------------------------------------------------------------------------------------------------------


def shared_out(sizes):
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, more = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                more += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = more
    return target


def copies_by_hand(rows):
    """The whole mix by a plain running sum: rows (doc_id, text, source) -> Counter of (doc_id, text, source, copies)."""
    def field(x):
        return "n" if x is None else f"{len(str(x).encode())}:{x}"

    words, groups = Counter(), {}
    for r in rows:
        words[r[2]] += len(re.findall(mixing.WORD, r[1] or ""))
        groups.setdefault(r[2], Counter())[r] += 1
    target, out = shared_out(words), Counter()
    for source, own in groups.items():
        key = "" if source is None else "=" + source
        rate = min(target[source] / words[source], 2.0) if words[source] else 0.0
        shift = int(hashlib.md5((mixing.SEED + key).encode()).hexdigest()[:8], 16) / 2**32
        blocks, order = -(-len(own) // mixing.BLOCK), []
        for r, n in own.items():
            digest = hashlib.sha256("".join(map(field, r)).encode()).hexdigest()
            order.append((int(int(digest[:8], 16) * blocks / 2**32), len(re.findall(mixing.WORD, r[1] or "")), digest, r, n))
        place = 0
        for *_, r, n in sorted(order):
            for _ in range(n):
                out[(*r, math.floor(shift + (place + 1) * rate) - math.floor(shift + place * rate))] += 1
                place += 1
    return out


@pytest.mark.parametrize(("block", "few"), [(1000, 100_000), (7, 2)])
def test_mix_against_a_running_sum(spark, monkeypatch, block, few):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", few)
    rng = random.Random(8)
    source = lambda i: ["a", "b", "B", "é", None, "empty"][min(5, int(rng.random() ** 3 * 6))]
    rows = [(i, None if (s := source(i)) == "empty" else "w " * rng.choice([0, 1, 5, 200]), s) for i in range(1500)]
    rows += [(7, "w w", "a")] * 400 + [(None, "w\tw", None)] * 30 + [(5, f"w {i}", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    want = copies_by_hand(rows)
    assert Counter((r.doc_id, r["size"], r.copies) for r in got) == sum((Counter({(i, len((t or "").split()), c): n}) for (i, t, _, c), n in want.items()), Counter())
    stage = mixing.stage(spark, docs, SF)
    assert Counter(map(tuple, stage.collect())) == sum((Counter({(i, t, s): c * n}) for (i, t, s, c), n in want.items() if c), Counter())
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    target = shared_out(words)
    for s, t in target.items():
        taken = sum(len((x or "").split()) * c * n for (_, x, y, c), n in want.items() if y == s)
        assert abs(taken - t) <= max(0.02 * t, 2 * 200)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mix_keeps_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, "c " * 5000, None)], "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.lit("old") for c in ("size", "digest", "times", "n", "piece", "index", "key", "row")}).withColumn("tags", F.array(F.lit("x")))
    out = mixing.stage(spark, docs, SF)
    assert out.columns == docs.columns and out.count() >= 3 and {r.digest for r in out.collect()} == {"old"}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.stage(spark, docs.limit(0), SF).count() == 0


# -- sharding ---------------------------------------------------------------------------------------------------------


def paths(store, version=None):
    return {r.file for r in store.manifest(version).collect()}


def plan_by_hand(files, target):
    """files (name, size) -> sets of files that one pass merges: runs of a tier, cut at the target, of FAN files or half a target."""
    tiers, runs = {}, []
    for name, size in sorted(files):
        if size < target / 2:
            tier = max(0, math.floor(math.log(max(size, 1) / sharding.BASE_BYTES) / math.log(sharding.FAN)))
            at, members = tiers.setdefault(tier, [0, {}])
            members.setdefault(at // target, []).append((name, size))
            tiers[tier][0] += size
    for _, members in tiers.values():
        for run in members.values():
            if len(run) >= sharding.FAN or (len(run) > 1 and sum(s for _, s in run) >= target / 2):
                runs.append(frozenset(n for n, _ in run))
    return set(runs)


def small_store(spark, tmp_path, monkeypatch, target=20_000):
    monkeypatch.setattr(sharding, "ARRIVAL_ROWS", 10)
    monkeypatch.setattr(sharding, "BASE_BYTES", 1 << 10)
    return sharding.Store(spark, f"file://{tmp_path}/s", target=target)


def test_compaction_keeps_every_row(spark, tmp_path, monkeypatch):
    rows = [(i, "t" * (i % 50) * 20 if i % 11 else None, i % 3) for i in range(500)] + [(7, "same", 1)] * 20 + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int").repartition(6)
    store = small_store(spark, tmp_path, monkeypatch)
    assert [store.append(docs), store.append(docs.limit(0)), store.append(docs.limit(40))] == [1, 2, 3]
    arrived, _, _ = store.read(docs.schema)
    before, small = arrived.select(docs.columns).collect(), store.manifest().count()
    assert len(before) == 561 and small > 50
    last = store.compact(docs.schema)
    assert last > 3 and store.versions() == list(range(1, last + 1))
    after, file, version = store.read(docs.schema)
    assert (file, version) == ("shard", "version") and after.columns == [*docs.columns, "shard", "version"]
    assert sorted(map(str, after.select(docs.columns).collect())) == sorted(map(str, before))
    live = store.manifest().collect()
    assert 1 < len(live) < small / 3 and sum(r["rows"] for r in live) == 561
    assert {r.version for r in after.select("version").distinct().collect()} == {last}


def test_each_pass_merges_the_runs_of_the_plan(spark, tmp_path, monkeypatch):
    store, rng = small_store(spark, tmp_path, monkeypatch), random.Random(4)
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh", k=rng.choice((5, 300, 2000))))) for i in range(400)], "doc_id long, text string").repartition(7)
    store.append(docs)
    passes = 0
    while True:
        live = store.manifest().collect()
        expected = plan_by_hand([(r.file, r.size) for r in live], store.target)
        done = store.merge(docs.schema)
        assert done == bool(expected)
        if not done:
            break
        passes += 1
        now, gone = store.manifest().collect(), set().union(*expected)
        assert {r.file for r in live} - {r.file for r in now} == gone
        made = [r for r in now if r.file not in {x.file for x in live}]
        size = {r.file: r for r in live}
        assert sorted(r["rows"] for r in made) == sorted(sum(size[f]["rows"] for f in run) for run in expected)
        assert sorted(r.raw for r in made) == sorted(sum(size[f].raw for f in run) for run in expected)
        assert all(sum(size[f].raw for f in run) <= 1.5 * sharding.RAW_FACTOR * store.target for run in expected)
    assert passes
    version = store.current()
    assert store.compact(docs.schema) == version  # a second compaction rewrites nothing


def test_files_of_target_size_and_lone_files_stay(spark, tmp_path, monkeypatch):
    store = small_store(spark, tmp_path, monkeypatch)
    text = spark.range(9).select(F.col("id").alias("doc_id"), F.expr("repeat(sha2(string(id), 512), 150)").alias("text"))
    big = text.select("doc_id", "text").repartition(1)
    for _ in range(5):
        store.append(big)  # each file fills more than half a target by its raw bytes
    small = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for _ in range(sharding.FAN - 1):
        store.append(small)
    before = paths(store)
    assert store.compact(big.schema) == 5 + sharding.FAN - 1 and paths(store) == before
    store.append(small)
    store.compact(big.schema)
    now = paths(store)
    assert len(before & now) == 5 and len(now) == 6


def test_versions_of_two_writers(spark, tmp_path, monkeypatch):
    store = small_store(spark, tmp_path, monkeypatch)
    other = sharding.Store(spark, store.root, store.target)
    entries = spark.createDataFrame([], sharding.MANIFEST)
    store.commit(entries, 1)
    with pytest.raises(sharding.Conflict, match="another writer"):
        other.commit(entries, 1)
    assert store.versions() == [1] and len(list((tmp_path / "s" / "manifest").iterdir())) == 1
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(80)], "doc_id long, text string").repartition(4)
    store.append(docs)
    merged = paths(store)
    # the other one merges the same files in between: what was planned on the old version fails, nothing is lost or doubled
    assert other.merge(docs.schema)
    with pytest.raises(sharding.Conflict, match="same files"):
        store.change(spark.createDataFrame([], sharding.MANIFEST), spark.createDataFrame([(f,) for f in merged], "file string"))
    # an append that loses the race is based anew on the winner's version
    true_commit, lost = store.commit, []

    def late(found, version):
        if not lost:
            lost.append(other.append(docs.limit(3)))
        return true_commit(found, version)

    monkeypatch.setattr(store, "commit", late)
    assert store.append(docs.limit(5)) == lost[0] + 1
    assert store.read(docs.schema)[0].count() == 88


def test_old_versions_stay_until_vacuum(spark, tmp_path, monkeypatch):
    store = small_store(spark, tmp_path, monkeypatch)
    docs = spark.createDataFrame([(i, "text " * i) for i in range(90)], "doc_id long, text string").repartition(3)
    store.append(docs)
    opened = store.read(docs.schema)[0]
    last = store.compact(docs.schema)
    assert last > 1 and opened.count() == 90 and store.read(docs.schema, 1)[0].select("doc_id").distinct().count() == 90
    (tmp_path / "s" / "data" / store.manifest().first().folder / "part-stray.parquet").write_bytes(b"never named by a manifest")
    assert store.read(docs.schema)[0].count() == 90
    store.vacuum(keep=1)
    assert store.versions() == [last] and store.read(docs.schema)[0].count() == 90
    assert len(list((tmp_path / "s" / "data").iterdir())) == 1


def test_sharding_query_and_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, shard string").limit(0)
    out, file, _ = sharding.shard(docs, f"file://{tmp_path}/e")
    assert out.count() == 0 and file == "_shard"
    rows = [(1, "x" * 3_000_000), (1, "x" * 3_000_000), (None, None), (2, "")]
    long = spark.createDataFrame(rows, "doc_id long, text string")
    out, _, _ = sharding.shard(long, f"file://{tmp_path}/l", target=1 << 20)
    assert sorted((r.doc_id or 0, len(r.text or ""), r.text is None) for r in out.collect()) == sorted((a or 0, len(b or ""), b is None) for a, b in rows)
    got, given = sharding.query(spark, SF), spark.read.parquet(f"{SF}/documents.parquet")
    assert got.columns == given.columns and got.exceptAll(given).count() == 0 and given.exceptAll(got).count() == 0
    many = [(f"f{i:05}", sharding.BASE_BYTES * (1 if i % 2 else 9)) for i in range(25_000)]
    live = spark.createDataFrame(many, "file string, size long").withColumn("tier", sharding.tier(F.col("size")))
    plan, runs = sharding.numbered(sharding.planned(live, 64 << 20))
    size, by = dict(many), {}
    for r in plan.collect():
        by.setdefault(r.number, []).append(size[r.file])
    assert sorted(by) == list(range(runs)) and all(len(set(v)) == 1 and sum(v) <= (64 << 20) + max(v) for v in by.values())
    assert sum(map(len, by.values())) > 24_900
