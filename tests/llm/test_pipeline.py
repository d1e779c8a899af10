"""The pipeline's stages on the smallest tables, each against a plain version on what the stage before kept."""

import hashlib
import os
import sys

from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline
from test_operators import PATHS, alnum, by_id, item_hits, plain_cut, true_classes

from versomill.llm import toxicity
from versomill.llm.common import written

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]

    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = by_id(toxicity.score(docs, model))
    kept = written(stages["toxicity"](spark, docs, SMALL), "t")
    assert kept.columns == columns
    assert set(by_id(kept)) == {k for k, r in scores.items() if r["score"] < 0.7}

    rows = sorted(by_id(kept).items())
    classes, _ = true_classes([r["text"] for _, r in rows], 5, 80)
    once = written(stages["near_dedup"](spark, kept, SMALL), "n")
    assert once.columns == columns
    assert sorted(by_id(once)) == [rows[k][0] for k, c in enumerate(classes) if c == k]

    rows = sorted(by_id(once).items())
    cut = written(stages["substring_dedup"](spark, once, SMALL), "s")
    assert cut.columns == columns
    want = {k: text for (k, _), (text, n, gone) in zip(rows, plain_cut([r["text"] for _, r in rows], 25)) if not gone or gone < n}
    assert {k: r["text"] for k, r in by_id(cut).items()} == want

    items = [(r["item_id"], alnum(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = by_id(stages["decontamination"](spark, cut, SMALL))
    for k, r in by_id(cut).items():
        w = alnum(r["text"])
        covered, _ = item_hits(w, items) if any(" ".join(i[:5]) in " ".join(w) for _, i in items) or len(w) < 400 else (set(), set())
        if covered and 20 * len(covered) >= len(w):
            assert k not in clean
        elif k in clean:
            assert alnum(clean[k]["text"]) == [y for i, y in enumerate(w) if i not in covered]

    final = by_id(corpus_pipeline.run(spark, SMALL))
    assert set(final) == set(clean)
    t = Tokenizer.from_file(PATHS["byte_bpe_50k.json"])
    for k, r in final.items():
        ids = t.encode(clean[k]["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["decoded_sha256"] == hashlib.sha256((clean[k]["text"] or "").encode()).hexdigest()
