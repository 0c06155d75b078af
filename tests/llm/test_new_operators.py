"""Whitening, URL filter and Merkle manifest against plain versions and on odd input."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pulsegrid.llm import merkle, queries, url_filters, whitening

DIR = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_whitening(vectors, components=8):
    """{index: (deviation, whitened)}, explained shares; components by the eigenvectors of the covariance."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = n * x.astype(object) - s.astype(object)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return (d * d).sum(axis=1), c @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    deviation, white, explained = plain_whitening([r.embedding for r in rows])
    at = {r.vec_id: k for k, r in enumerate(rows)}
    found = queries.op11_whitening(spark, DIR).collect()
    assert len(found) == 8 * len(rows) and {(r.vec_id, r.component) for r in found} == {(r.vec_id, c) for r in rows for c in range(1, 9)}
    sign = {}
    for r in found:
        k, c = at[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (len(rows), deviation[k])
        assert abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9
        if abs(white[k, c]) > 0.1:
            assert sign.setdefault(c, np.sign(r.whitened * white[k, c])) == np.sign(r.whitened * white[k, c])
        assert abs(abs(r.whitened) - abs(white[k, c])) < 1e-7


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_odd_rows(spark, parts):
    rng = np.random.default_rng(5)
    good = [[float(v) for v in row] for row in rng.normal(size=(60, 3)) * [3, 1, 0.5] + 7]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e30, 1.0, 1.0], [1.0, 2.0]]
    rows = [(k if k % 7 else None, v, "z") for k, v in enumerate([*good, good[3], *bad])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(parts)
    found = whitening.whitened_components(df).collect()
    deviation, white, explained = plain_whitening([*good, good[3]], 3)
    assert len(found) == 3 * 61 and {r.n for r in found} == {61}
    assert sorted(int(r.deviation) for r in found) == sorted(int(d) for d in deviation for _ in range(3))
    for c in range(3):
        assert np.allclose(sorted(abs(r.whitened) for r in found if r.component == c + 1), sorted(abs(white[:, c])), atol=1e-9)
        assert {round(r.explained, 9) for r in found if r.component == c + 1} == {round(explained[c], 9)}
    assert max(r.identity_error for r in found) < 1e-9
    assert whitening.whitened_components(df.limit(0)).count() == 0
    assert whitening.whitened_components(df.filter("size(embedding) = 0")).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], "vec_id long, embedding array<float>")
    assert whitening.whitened_components(same).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id string, embedding array<float>")
    assert {r.component for r in whitening.whitened_components(line).collect()} == {1}


def test_exact_sums_of_large_entries(spark):
    big = 2.0**42
    df = spark.createDataFrame([(k, [big + k, 1.0 * k]) for k in range(5000)], "vec_id long, embedding array<double>")
    n, sums = whitening.exact_sums(whitening.usable(df, "vec_id", "embedding"), 1024, 100_000)
    assert (n, sums) == (5000, [sum(int(1024 * (big + k)) + 100_000 for k in range(5000)), sum(1024 * k + 100_000 for k in range(5000))])
    found = whitening.whitened_components(df).filter("component = 1").collect()
    x = [(int(1024 * (big + k)) + 100_000, 1024 * k + 100_000) for k in range(5000)]
    expected = [sum((5000 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert sorted(int(r.deviation) for r in found) == sorted(expected)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(UPPER), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def plain_verdicts(pages, links, parents=True, damping=0.85):
    """(id, host, path, rule, verdict or None where it is close) by dense linear algebra; links: sets of targets by page."""
    out, trusted, blocked, weight = [], defaultdict(int), defaultdict(int), defaultdict(int)
    for (i, url), to in zip(pages, links, strict=True):
        host, path = split_url(url)
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[2:] if fits else (None, None)
        out.append((i, host, path, *rule))
        if host:
            (trusted if rule[1] == "allow" else blocked if rule[1] else defaultdict(int))[host] += 1
            for t in to:
                if t and t != host:
                    weight[host, t] += 1
    up = set()
    for h in {o[1] for o in out if o[1]}:
        while parents and h.count(".") >= 2:
            up.add((h, h.split(".", 1)[1]))
            h = h.split(".", 1)[1]
    for a, b in up:
        weight[a, b] += 1
        weight[b, a] += 1
    names = sorted({o[1] for o in out} | {h for e in weight for h in e})
    at = {h: k for k, h in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for (a, b), c in weight.items():
        w[at[a], at[b]] = c

    def rank(m, seeds):
        p = np.array([float(seeds[h]) for h in names])
        if not p.sum():
            return p
        rows = m.sum(axis=1, keepdims=True)
        share = np.divide(m, rows, out=np.zeros_like(m), where=rows > 0)
        x = np.linalg.solve(np.eye(len(names)) - damping * share.T, p / p.sum())
        return x / x.sum()

    t, d = rank(w, trusted), rank(w.T, blocked)
    close = abs(t - d) < 5e-4
    return [(*o[:4], o[4] or (None if o[1] and close[at[o[1]]] and (t + d)[at[o[1]]] > 0 else "block" if o[1] and d[at[o[1]]] > t[at[o[1]]] else "allow")) for o in out], {h: (t[at[h]], d[at[h]]) for h in names}


def check_verdicts(found, expected, shares):
    assert len(found) == len(expected)
    key = lambda r: repr(r[:3])
    for r, e in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert r[:4] == e[:4] and e[4] in (None, r[4]), (r, e)
        t, d = shares.get(r[1], (0, 0))
        assert not r[1] or abs(r[5] - t) < 1e-3 and abs(r[6] - d) < 1e-3, (r, t, d)


COLUMNS = ("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def test_url_filter_of_the_table(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()]
    expected, shares = plain_verdicts(pages, [set()] * len(pages))
    found = [tuple(r) for r in queries.op12_url_filter(spark, DIR).select(*COLUMNS).collect()]
    check_verdicts(found, expected, shares)
    assert {r[4] for r in found} == {"allow", "block"} and any(r[3] is None for r in found)


@pytest.mark.parametrize("parents", [True, False])
def test_url_filter_links_and_odd_rows(spark, parents):
    a = lambda *hosts: "<p>" + "".join(f"<A class=x HREF={q}{h}/p?q#f{q}>t</a>" for h, q in zip(hosts, "\"' " * 9, strict=False)) + "<a name=z>"
    pages = [
        (1, "http://Good.example.ORG/x", a("https://mid.test", "//mid.test", "/own")), (2, "https://mid.test/a?b://c", a("http://far.test:80")), (3, "http://far.test:80", None),
        (4, "ftp://bad.com/de/1", a("http://mid.test")), (5, "http://spam.test/", a("http://bad.com", "HTTP://spam.test/")), (6, "http://farm.test/#x", a("//spam.test")), (None, None, "<a href=//x.test>"),
        (7, "no scheme", a("http://mid.test")), (8, "://", ""), (8, "://", ""), (9, "http://a.b.example.org/es/1", None), (10, "http://example.org/en/1?x", ""), (11, "http://example.org?x", ""),
        (12, "http://notexample.org/es/", ""), (13, "http://é.Éxample.com/fr/", ""), (14, "http://org/", ""), (15, "http://x.org\n/a\nb", ""), (16, "http://lone.test/", ""), (16, "http://lone.test/", ""),
    ]
    targets = [{"mid.test"}, {"far.test:80"}, (), {"mid.test"}, {"bad.com", "spam.test"}, {"spam.test"}, (), (), *[()] * 11]
    df = spark.createDataFrame([(*p, "z", 0.5) for p in pages], "page_id long, url string, html string, host string, trust double")
    expected, shares = plain_verdicts([p[:2] for p in pages], targets, parents)
    found = [tuple(r) for r in url_filters.judge_urls(df, parents=parents).select(*COLUMNS).collect()]
    check_verdicts(found, expected, shares)
    by = {r[0]: r for r in found}
    assert by[6][4] == by[5][4] == "block" and by[2][4] == by[3][4] == "allow" and by[None][1:5] == ("", "", None, "allow")
    assert by[11][3] is None and by[10][3] == "example.org/en/1" and by[12][3] == "org/"
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fan_out):
    """(top, siblings of each node level by level, with those before and after apart)."""
    paths, levels = [[] for _ in nodes], [list(range(len(nodes)))]
    here = nodes
    at = levels[0]
    while len(here) > 1:
        for k, place in enumerate(at):
            run = here[place // fan_out * fan_out : place // fan_out * fan_out + fan_out]
            paths[k].append((run[: place % fan_out], run[place % fan_out + 1 :]))
        here = [h("".join(here[i : i + fan_out])) for i in range(0, len(here), fan_out)]
        at = [place // fan_out for place in at]
    return here[0], paths


def plain_manifest(rows, tamper, fan_out=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, own = [], {}
    for s in names:
        ordered = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = climb([leaf(r) for r in ordered], fan_out)
        tops.append(top)
        own[s] = list(zip(ordered, paths, strict=True))
    root, upper = climb(tops, fan_out)
    out = []
    for s, top, above in zip(names, tops, upper, strict=True):
        for r, path in own[s]:
            changed = r[:4] + (None if r[4] is None else r[4].translate(UPPER),) if tamper(r) else r
            node = leaf(changed)
            for before, after in path + above:
                node = h("".join([*before, node, *after]))
            out.append((r[0], leaf(r), top, root, h("".join("".join(b + a) for b, a in path + above)), node, node == root))
    return sorted(out, key=repr)


FIELDS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select(*merkle.FIELDS).collect()]
    expected = plain_manifest(rows, lambda r: zlib.crc32(str(r[0]).encode()) % 5 == 0)
    found = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, DIR).select(*FIELDS).collect()), key=repr)
    assert found == expected and {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("fan_out,leaves,n", [(16, 7, 300), (3, 5, 60), (2, 1, 12), (16, 40, 1)])
def test_manifest_edges_and_odd_rows(spark, fan_out, leaves, n):
    rows = [(k if k % 9 else None, ["hot", "hot", "hot", f"s{k % 20}", None, "é"][k % 6], None, None if k % 4 else k, [None, "", "Text", "É x" * k][k % 4]) for k in range(n)]
    rows += rows[: n // 3]
    df = spark.createDataFrame([(*r, "z", b"x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp binary").repartition(3)
    sample = merkle.F.col("doc_id") % 5 == 0
    found = merkle.manifest(df, tampered=merkle.lowered_text(sample), fan_out=fan_out, partition_leaves=leaves)
    got = sorted((tuple(r) for r in found.select("id", *FIELDS[1:]).collect()), key=repr)
    assert got == plain_manifest(rows, lambda r: r[0] is not None and r[0] % 5 == 0, fan_out)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_differing_sources(spark):
    one = spark.createDataFrame([(k, f"s{k % 3}", "en", k, f"t{k}") for k in range(60)], "doc_id long, source string, lang string, n_chars long, text string")
    two = one.withColumn("text", merkle.F.when(merkle.F.col("doc_id") == 7, "other").otherwise(merkle.F.col("text")))
    a, b = merkle.manifest(one), merkle.manifest(two)
    assert merkle.differing_sources(a, merkle.manifest(one.repartition(5))).count() == 0
    assert merkle.differing_sources(a, b).count() == 2
