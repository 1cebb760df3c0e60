"""URL rules, licences, quality rules and scores."""

import re
import textwrap
from collections import Counter

import numpy as np
import pytest

from tessera.llm import license_rules, pu_quality, quality_rules, url_rules
from tessera.llm.queries import ORACLES, QUERIES

from ..conftest import SF
from .cases import empty, frame, odd, some, words_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(same, name):
    same(QUERIES[name], ORACLES[name])


# URLs


def url_truth(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark):
    urls = [None, "", "example.net/en/", "http://example.net", "http://EXAMPLE.net/en/x?q#f", "http://a.b.example.net/en/", "http://anet/", "http://x.net/", "net://net/a", "http://example.net?/en/", "http://example.com/de/", "http://de.example.com/de", "http://org/fr/#x", "http://x.y.org/fr/a://b", "http://.net/", "http://net./", "http://net-x/", "http:///en/", "http://example.net:80/en/", "http://É.net/", "http://a.example.net//en/"]
    rules = [*url_rules.RULES, ("b.example.net", "/", "block"), ("example.net", "/en/deep/", "block"), ("a.b.example.net", "/en/", "allow"), ("x.org", "/", "block")]
    urls += ["http://b.example.net/en/", "http://q.b.example.net/x", "http://example.net/en/deep/1", "http://x.org/fr/"]
    df = spark.createDataFrame([(k, u, "q", 1) for k, u in enumerate(urls)] + [(0, None, None, None), (None, "http://x.net/", "h", 1)], "page_id long, url string, host string, salt long")
    for given in (url_rules.RULES, rules):
        got = sorted((tuple(r) for r in url_rules.judge(df, url_rules.rule_table(spark, given)).collect()), key=repr)
        assert got == sorted(((r.page_id, *url_truth(r.url, given)) for r in df.collect()), key=repr)
    none = url_rules.rule_table(spark, rules).where("false")
    assert {r.verdict for r in url_rules.judge(df, none, "block").collect()} == {"block"}
    assert url_rules.judge(df.where("false"), none).count() == 0


def test_native_plans(spark):
    for name in ("op5_url_rules", "op7_license_rules"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


# Licences


def test_licenses(spark):
    s = license_rules.SENTENCES
    mit = "\n\n".join([f"{s['mit-grant']}\n", s["mit-condition"], f"{s['as-is']} {s['no-liability']}"])
    texts = {
        1: "x\nReleased under the MIT License.\ny",
        2: "released  UNDER the mit license!!\n\nLicensed under CC BY-NC 4.0. More.",
        3: mit,
        4: mit.replace(s["mit-condition"], ""),
        5: "This is the MIT License.",
        6: f"{s['bsd-grant']}\n1. Redistributions\n{s['bsd-source']}\n{s['bsd-binary']}\nOther words.\n{s['bsd-endorse']}",
        7: "notReleased under the MIT License.",
        8: " ".join([s["gpl3-free"], s["gpl-warranty"], s["gpl-details"]]),
    }
    got = {r.doc_id: r.licenses for r in license_rules.scan(frame(spark, list(texts.items()))).collect()}
    assert got == {1: "MIT", 2: "CC-BY-NC-4.0,MIT", 3: "MIT", 4: "", 5: "", 6: "BSD-2-Clause,BSD-3-Clause", 7: "", 8: "GPL-3.0"}
    rows = license_rules.scan(odd(spark)).collect()
    assert len(rows) == odd(spark).count() and {r.licenses for r in rows} == {""}
    assert license_rules.scan(empty(spark)).count() == 0


def test_known_sentences_are_recognised(spark):
    ids, _ = license_rules.compiled(license_rules.SENTENCES, license_rules.RULES)
    rows = license_rules.scan(frame(spark, list(enumerate(license_rules.SENTENCES.values())))).collect()
    assert len(ids) == len(license_rules.SENTENCES) or all(r.n_sentences >= 1 for r in rows)
    with pytest.raises(ValueError):
        license_rules.compiled({"x": "nothing known"}, [("X", ["x"])])


def test_wrapped_licenses(spark):
    s = license_rules.SENTENCES
    wrap = lambda text, mark="", width=72: "\n".join(mark + x for x in textwrap.wrap(text, width))
    mit = "\n\n".join(["The MIT License", "Copyright (c) 2020 Some One", wrap(s["mit-grant"]), wrap(s["mit-condition"]), wrap(f"{s['as-is']} {s['no-liability']}")])
    apache = f"# Copyright 2020 Some One\n#\n{wrap(s['apache-header'] + ' ' + s['apache-copy'], '# ')}\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n{wrap(s['apache-as-is'] + ' ' + s['apache-see'], '# ')}\n\nimport os\n"
    bsd = "/*\n * Copyright.\n * All rights reserved.\n *\n" + "\n".join([wrap(s["bsd-grant"], " * "), " *", wrap("1. " + s["bsd-source"], " * "), wrap("2. " + s["bsd-binary"], " *    "), wrap("3. " + s["bsd-endorse"], " * ")]) + "\n */\nint main;"
    gpl = "frob - frobs things\n" + wrap(" ".join([s["gpl2-free"], s["gpl-warranty"], s["gpl-details"]]), "// ", 60)
    mpl = s["mpl-notice"]
    texts = {
        1: mit,
        2: mit.replace("\n", "\r\n"),
        3: apache,
        4: bsd,
        5: gpl,
        6: wrap(s["isc-grant"], "; ", 40),
        7: wrap(mpl, "-- ", 30),
        8: mpl.replace("2.0", "1.1"),
        9: mpl,
        10: mit.replace("to deal in", "to trade in"),
        11: mit.replace("Permission is hereby", "Permission is\n\nhereby"),
        12: " ".join([s["bsd-grant"], "1.", s["bsd-source"], "2.", s["bsd-binary"]]),
        13: "Released under the MIT License\nLicensed under CC BY 4.0\nother words",
    }
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in license_rules.scan(frame(spark, list(texts.items()))).collect()}
    assert got == {1: ("MIT", 4), 2: ("MIT", 4), 3: ("Apache-2.0", 4), 4: ("BSD-2-Clause,BSD-3-Clause", 4), 5: ("GPL-2.0", 3), 6: ("ISC", 1), 7: ("MPL-2.0", 1), 8: ("", 0), 9: ("MPL-2.0", 1), 10: ("", 3), 11: ("", 3), 12: ("BSD-2-Clause", 3), 13: ("CC-BY-4.0,MIT", 2)}


# Quality rules


def base_truth(text):
    text = text or ""
    words = words_of(text, lower=False)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


def test_base_rules(spark):
    for docs in (some(spark), odd(spark)):
        want = sorted(((r.doc_id, *base_truth(r.text)) for r in docs.collect()), key=repr)
        got = quality_rules.judge(docs).collect()
        assert sorted((tuple(r)[:7] for r in got), key=repr) == want
        assert all(not (r.base_failed and r.kept) for r in got)
    assert quality_rules.judge(empty(spark)).count() == 0


def mcd_truth(rows, cover, steps):
    """The same estimate with numpy, for one group."""
    unit, step = quality_rules.UNIT, quality_rules.STEP
    x = np.array(rows, np.float64)
    floors = np.array([f for _, f in quality_rules.STATISTICS])
    q = np.percentile(np.floor(x / 10 + 0.5) * 10, [25, 50, 75], axis=0)
    centre, whiten = q[1] / unit, np.diag(1 / np.sqrt(((q[2] - q[0]) / 1.349 / unit) ** 2 + floors**2))

    def distance():
        z = (x / unit - centre) @ whiten.T
        return np.floor(np.log1p((z * z).sum(1)) * step + 0.5)

    for _ in range(steps):
        d = distance()
        inside = x[d <= np.percentile(d, 100 * cover)] / unit
        centre = inside.mean(0)
        whiten = np.linalg.inv(np.linalg.cholesky(np.cov(inside.T, bias=True) + np.diag(floors**2)))
    return centre, whiten


def test_estimates_against_numpy(spark):
    docs = some(spark, sf="0.01")
    rows = quality_rules.written(quality_rules.measured(docs))
    grouped = quality_rules.written(quality_rules._grouped(rows, 200))
    known = {r.g: r for r in quality_rules.estimates(grouped).collect()}
    by_group = {}
    for r in grouped.collect():
        by_group.setdefault(r.g, []).append([r[n] for n in quality_rules._NAMES])
    assert set(known) == set(by_group) and len(known) > 1
    for g, own in by_group.items():
        centre, whiten = mcd_truth(own, quality_rules.COVER, quality_rules.STEPS)
        np.testing.assert_allclose(known[g].c, centre, rtol=1e-6, atol=1e-9)
        np.testing.assert_allclose(np.reshape(known[g].w, whiten.shape), whiten, rtol=1e-6, atol=1e-9)


def test_results_do_not_depend_on_partitions(spark):
    docs = some(spark, sf="0.01")
    one, two = (sorted(map(tuple, quality_rules.judge(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == two


def test_salted_parameters(spark, monkeypatch):
    docs = some(spark, sf="0.01")
    want = sorted(map(tuple, quality_rules.judge(docs).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, quality_rules.judge(docs).collect())) == want


def test_clean_documents_stay(spark):
    docs = some(spark, sf="0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = quality_rules.judge(docs).collect()
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert all(r.kept for r in good) and sum(not r.kept for r in bad) > 0.7 * len(bad)
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_filtered_tells_rows_of_one_id(spark):
    """A rejected row takes no other text with it that has its id, or none."""
    good = [" ".join(f"word{j}{k}" for j in range(30)) for k in range(4)]
    rows = [(None, good[0]), (None, "too few"), (None, None), (1, good[1]), (1, "too few"), (2, good[2]), (2, good[2]), (3, good[0]), (None, good[3])]
    kept = [tuple(r) for r in quality_rules.filtered(frame(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted((r for r in rows if r[1] and r[1] != "too few"), key=repr)


# Scores


def test_scores(spark):
    docs, labels = some(spark, sf="0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in pu_quality.score(docs, labels).collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    known = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(known) > 80 and np.mean([r.predicted == q for r, q in known]) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())


def test_scores_learn_nothing_from_held_out_labels(spark):
    docs = some(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(pu_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({(r.doc_id, r.score) for r in pu_quality.score(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_scores_of_odd_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert pu_quality.score(odd(spark), labels).count() == odd(spark).count()
    assert {r.score for r in pu_quality.score(some(spark), labels.where("false")).collect()} == {0.5}
    assert pu_quality.score(empty(spark), labels).count() == 0


def test_risk_is_non_negative():
    rng = np.random.default_rng(0)
    positive, unlabelled = rng.normal(2, 1, (300, 3)), np.concatenate([rng.normal(2, 1, (500, 3)), rng.normal(-2, 1, (500, 3))])
    net, risks = pu_quality.fit(positive, unlabelled, 0.5)
    assert min(risks) >= 0 and risks[-1] < risks[0]
    assert net.score(rng.normal(2, 1, (200, 3))).mean() > 0.9 and net.score(rng.normal(-2, 1, (200, 3))).mean() < 0.1
    numeric = _numeric_gradient(positive[:20], unlabelled[:40])
    assert numeric < 1e-5


def _numeric_gradient(positive, unlabelled):
    """The largest difference of the backward pass from finite differences."""
    net = pu_quality.Network(3, 4)
    x, h, z = net.forward(unlabelled)
    grads = net.gradients(x, h, 1 / (1 + np.exp(-z)) / len(z))
    worst = 0.0
    for part, grad in zip(net.parts, grads, strict=True):
        flat, g = part.ravel(), np.ravel(grad)
        for k in range(len(flat)):
            old, values = flat[k], []
            for e in (1e-5, -1e-5):
                flat[k] = old + e
                values.append(np.logaddexp(0, net.forward(unlabelled)[2]).mean())
            flat[k] = old
            worst = max(worst, abs((values[0] - values[1]) / 2e-5 - g[k]))
    return worst


def test_covariance_decides(spark):
    """The floors of statistics that vary are a small part of their variance, the
    median isn't held back, and a row that only leaves the others' spread is rejected."""
    docs = some(spark, sf="0.01")
    grouped = quality_rules.written(quality_rules._grouped(quality_rules.measured(docs), 200))
    floors = dict(quality_rules.STATISTICS)
    for r in quality_rules.estimates(grouped).collect():
        own = np.linalg.inv(np.reshape(r.w, (6, 6)))
        variance = np.diag(own @ own.T)
        for k in (0, 2, 3):
            assert floors[quality_rules.STATISTICS[k][0]] ** 2 < 0.1 * variance[k]
        assert 2.5 < r.dof < 4
        assert np.expm1(r.middle / quality_rules.STEP) / quality_rules.chi_square(0.0, r.dof) > 1
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    rows = [(k, " ".join(word() for _ in range(400)) + ".") for k in range(300)]
    rows.append((300, " ".join(word().title() if j % 10 == 0 else word() for j in range(400)) + "."))
    gone = {r.doc_id for r in quality_rules.judge(frame(spark, rows)).collect() if not r.kept}
    assert 300 in gone and len(gone) < 15


def verdict_truth(rows):
    """Distances and verdicts of (lang, source, n_words, n_repeat_words, vector) by numpy alone."""
    unit, step, d = quality_rules.UNIT, quality_rules.STEP, len(quality_rules.STATISTICS)
    floors, prior = (np.diag(np.square(x)) for x in ([f for _, f in quality_rules.STATISTICS], quality_rules.PRIOR))
    vectors = np.array([r[4] for r in rows], np.float64) / unit
    half = lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)
    far = lambda x, c, w: half(np.log1p((((x - c) @ w.T) ** 2).sum(1)) * step)
    whiten = lambda v: np.linalg.inv(np.linalg.cholesky(v))

    def moved(x, c, w):
        at = far(x, c, w)
        own = x[at <= np.percentile(at, 100 * quality_rules.COVER)]
        v = np.cov(own.T, bias=True).reshape(d, d) if len(own) > 1 else np.zeros((d, d))
        return round(np.linalg.slogdet(v + floors)[1], 9), own.mean(0), v

    def estimate(x):
        q = np.percentile(half(x * unit / 10) * 10, [25, 50, 75], axis=0) / unit
        w = np.diag(1 / np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + np.diag(floors)))
        z = (x - q[1]) @ w
        length = np.sqrt((z * z).sum(1, keepdims=True))
        t, u = half(np.tanh(z) * unit) / unit, half(np.divide(z, length, out=np.zeros_like(z), where=length > 0) * unit) / unit
        shapes = [np.cov(t.T, bias=True).reshape(d, d) if len(t) > 1 else np.zeros((d, d)), u.T @ u / len(u)]
        found = []
        for start in (w, *(whiten(m + 1e-6 * np.eye(d)) @ w for m in shapes)):
            c, own = q[1], start
            for _ in range(quality_rules.TRIALS):
                det, c, v = moved(x, c, own)
                own = whiten(v + floors)
            found.append((det, c, v))
        now = min(found, key=lambda s: s[0])
        for _ in range(quality_rules.MOST_STEPS):
            new = moved(x, now[1], whiten(now[2] + floors))
            if new[0] >= now[0]:
                break
            now = new
        return now[1:]

    keys = [[(r[0], r[1]), (r[0],), ()] for r in rows]
    groups = {}
    for k, own in enumerate(keys):
        for g in own:
            groups.setdefault(g, []).append(k)
    states = {g: estimate(vectors[at]) for g, at in groups.items()}
    n = {g: len(at) for g, at in groups.items()}
    drawn = lambda m, own, weight, to: (m * own + weight * to) / (m + weight)
    params = {}
    for own in {tuple(k) for k in keys}:
        c, v = states[()]
        v = drawn(n[()], v, quality_rules.PRIOR_ROWS, prior)
        for g in (own[1], own[0]):
            c, v = drawn(n[g], states[g][0], quality_rules.POOL, c), drawn(n[g], states[g][1], quality_rules.POOL, v)
        w = whiten(v + floors)
        params[own[0]] = c, w, max(1.0, np.trace(w @ v @ w.T))
    at = np.array([far(vectors[k : k + 1], *params[own[0]][:2])[0] for k, own in enumerate(keys)])
    middle = {g: np.expm1(np.percentile(at[own], 50) / step) for g, own in groups.items()}
    out = []
    for k, (row, own) in enumerate(zip(rows, keys, strict=True)):
        dof = params[own[0]][2]
        usual = quality_rules.chi_square(0.0, dof)
        scale = drawn(n[()], middle[()] / usual, quality_rules.PRIOR_ROWS, 1.0)
        for g in (own[1], own[0]):
            scale = drawn(n[g], middle[g] / usual, quality_rules.POOL, scale)
        distance = np.expm1(at[k] / step) / max(scale, 1.0)
        failed = row[2] < 10 or 100 * row[3] > 20 * row[2]
        out.append((distance, not failed and distance <= quality_rules.chi_square(quality_rules.CUT, dof)))
    return out


def test_verdicts_against_numpy(spark):
    """Distances and verdicts of all rows: starts, least determinant, groups of any
    size drawn to larger ones, scale and cut."""
    for docs in (some(spark, sf="0.01").where("doc_id < 500"), odd(spark)):
        rows = quality_rules.written(quality_rules._levels(quality_rules.measured(docs))).collect()
        truth = verdict_truth([(r.lang, r.source, r.n_words, r.n_repeat_words, [r[x] for x in quality_rules._NAMES]) for r in rows])
        want = sorted(((r.doc_id, r.n_words, *t) for r, t in zip(rows, truth, strict=True)), key=repr)
        got = sorted(((r.doc_id, r.n_words, r.distance, r.kept) for r in quality_rules.judge(docs).collect()), key=lambda r: repr((*r[:2], 0)))
        want.sort(key=lambda r: repr((*r[:2], 0)))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        off = [(a, b) for a, b in zip(got, want, strict=True) if a[3] != b[3] or abs(a[2] - b[2]) > 1e-3 * (1 + b[2])]
        assert not off, off[:5]


def test_licenses_that_are_nearly_known(spark, duck):
    """Versions, kin and cuts that differ are told apart, by the operator and by the SQL."""
    s = license_rules.SENTENCES
    wrap = lambda text, mark="# ", width=64: "\n".join(mark + x for x in textwrap.wrap(text, width))
    lesser, affero = (" ".join(s[k] for k in names) for names in (("lgpl21-free", "lgpl-warranty", "lgpl-details"), ("agpl3-free", "gpl-warranty", "agpl-details")))
    texts = {
        1: s["mpl-notice"].replace("2.0", "1.1"), 2: s["mpl11-notice"], 3: wrap(s["mpl11-notice"]), 4: s["mpl11-notice"].replace("1.1", "2.0"),
        5: s["apache-notice"].replace("2.0", "1.1"), 6: s["apache-header"].replace("2.0", "1.1"), 7: wrap(lesser), 8: lesser.replace("2.1", "3"),
        9: wrap(affero, " * "), 10: affero.replace("Affero ", ""), 11: affero.replace("see", "look"), 12: " ".join([s["gpl3-free"], s["gpl-warranty"], s["agpl-details"]]),
        13: s["ccby-notice"].replace("4.0", "3.0"), 14: s["gpl2-notice"].replace("2", "3"), 15: s["bsd-notice"] + " " + s["isc-notice"] + "\n\n" + s["mit-notice"], 16: None, 17: "",
        18: "Licensed under the\n\nMIT License.", 19: "Licensed under\nthe MIT License", 20: s["as-is"] + "\n" + s["as-is"],
    }
    want = {1: "", 2: "MPL-1.1", 3: "MPL-1.1", 4: "", 5: "", 6: "", 7: "LGPL-2.1", 8: "", 9: "AGPL-3.0", 10: "GPL-3.0", 11: "AGPL-3.0", 12: "", 13: "", 14: "GPL-3.0", 15: "BSD,ISC,MIT", 16: "", 17: "", 18: "", 19: "MIT", 20: ""}
    got = sorted(tuple(r) for r in license_rules.scan(frame(spark, list(texts.items()))).collect())
    assert {r[0]: r[2] for r in got} == want
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE given (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?)", list(texts.items()))
    assert sorted(con.execute(ORACLES["op7_license_rules"].replace("documents", "given")).fetchall()) == got


def test_risk_against_its_definition():
    """The non-negative unbiased risk summed row by row, and its slopes by differences."""
    rng = np.random.default_rng(3)
    loss = lambda z, y: float(np.log1p(np.exp(-y * z)))
    for shift in (-2.0, 2.0):  # the bracket is negative at one of them
        zp, zu = rng.normal(shift, 1, 30), rng.normal(-abs(shift), 1, 50)
        for prior in (0.2, 0.7):
            plus = sum(loss(z, 1) for z in zp) / 30
            bracket = sum(loss(z, -1) for z in zu) / 50 - prior * sum(loss(z, -1) for z in zp) / 30
            risk, dp, du = pu_quality.non_negative_risk(zp, zu, prior)
            assert abs(risk - (prior * plus + max(0.0, bracket))) < 1e-9
            aim = (lambda p, u, q=prior: q * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - q * np.logaddexp(0, p).mean()) if bracket >= 0 else (lambda p, u, q=prior: q * np.logaddexp(0, p).mean() - np.logaddexp(0, u).mean())
            for z, d, own in ((zp, dp, 0), (zu, du, 1)):
                for k in range(5):
                    up, down = ([zp.copy(), zu.copy()] for _ in range(2))
                    up[own][k] += 1e-6
                    down[own][k] -= 1e-6
                    assert abs((aim(*up) - aim(*down)) / 2e-6 - d[k]) < 1e-6


def test_prior_without_negatives(spark):
    rng = np.random.default_rng(1)
    draw = lambda n, share: np.where(rng.random((n, 1)) < share, rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (n, 4)))
    for share in (0.2, 0.5, 0.9):
        assert abs(pu_quality.estimated_prior(draw(3000, 1), draw(3000, share)) - share) < 0.06
    scores, others = rng.random(40), rng.random(60)
    plain = min(((np.mean(others >= c) + sum(np.sqrt(np.log(40) / 2 / n) for n in (40, 60))) / np.mean(scores >= c), np.mean(others >= c) / np.mean(scores >= c)) for c in scores)
    assert abs(pu_quality.least_ratio(scores, others) - plain[1]) < 1e-9
    docs, labels = some(spark), spark.read.parquet(f"{SF}/labels.parquet")
    one, two = ({(r.doc_id, r.score) for r in pu_quality.score(docs, x).collect()} for x in (labels, labels.where("quality = 1")))
    assert one == two  # labels of 0 are not used
