import random
import re
from collections import Counter

import corpus_pipeline
from tessera.llm.runtime import written

from .cases import empty, frame, odd, some
from .test_dedup import near_truth, substring_truth
from .test_tokens import check_pieces


def test_stages(spark):
    docs = some(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, ""))
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if k < 4:
            assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        kept = {r.doc_id for r in out.collect()}
        if name == "exact dedup":
            plain = {}
            for d, t in sorted(rows):
                plain.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
            assert kept == set(plain.values())
        elif name == "n-gram Jaccard join":
            assert kept == {d for d, (_, c) in near_truth(rows, 5, 80).items() if c == d}
        elif name == "suffix-array dedup":
            truth = {r[0]: r[2] for r in substring_truth(rows, 400)}
            assert len(kept) == len(rows)
            assert {r.doc_id for r in out.collect() if r.text != dict(rows)[r.doc_id]} == {d for d, n in truth.items() if n}
            assert all(r.n_chars == len(r.text) for r in out.collect() if truth[r.doc_id])
        elif name == "packing":
            check_pieces(out.collect(), docs)
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_odd_rows(spark):
    for docs in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, ""))
        assert "sequence_id" in docs.columns


def test_repeats_of_short_words(spark):
    """Passages of 51 words or more go however few bytes they have, and of 50 stay."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    run = lambda n: [word() for _ in range(n)]
    shared = [run(n) for n in (50, 51, 52, 55, 60)] + [[rng.choice("abc") for _ in range(51)]]
    rows = []
    for k in range(60):
        a, b, s = run(rng.randint(0, 30)), run(rng.randint(0, 30)), shared[k % 6]
        # White space may differ, and the ends of passages may be cut.
        s = s[rng.choice([0, 0, 1]) : len(s) - rng.choice([0, 0, 2])]
        rows.append((k, " ".join(a) + " " + rng.choice([" ", "\n", "  "]).join(s) + " " + " ".join(b)))
    rows += [(100, " ".join(shared[0])), (101, " ".join(shared[1])), (102, " ".join(shared[1])), (103, "x " * 60), (104, None), (105, "")]
    for given in (rows, [(r.doc_id, r.text) for r in some(spark).collect()]):
        words = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in given}
        seen = Counter(tuple(w[i : i + 51]) for w in words.values() for i in range(len(w) - 50))
        bytes_too = {r[0] for r in substring_truth(given, 400) if r[2]}
        got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, frame(spark, given).repartition(4), "").collect()}
        assert len(got) == len(given)
        for d, t in given:
            own = words[d]
            gone = {j for i in range(len(own) - 50) if seen[tuple(own[i : i + 51])] > 1 for j in range(i, i + 51)}
            if d not in bytes_too:
                assert (got[d] or "").encode().split() == [w for j, w in enumerate(own) if j not in gone]
                assert gone or got[d] == t
            else:
                assert len(got[d].encode().split()) <= len(own) - len(gone) + 1
