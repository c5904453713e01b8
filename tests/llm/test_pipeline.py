"""The pipeline's stages: decisions take effect, columns stay, each stage agrees with its operator's query."""

from collections import Counter

import corpus_pipeline
from leafstack.llm import contamination, language, mixing, simhash

from .conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, results[-1], SF).cache()
        results.append(out)
        if k < 4:
            assert out.columns == columns, name
    ids = [Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in results]
    # 1: nothing with a recognised language is lost
    found = {r["doc_id"]: r for r in language.languages(results[0], corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert set(ids[1]) == {d for d, r in found.items() if r["lang_pred"] != "und" and r["score"] >= 0.5} and len(ids[1]) > 0.95 * len(ids[0])
    # 2: one of each group, the smallest id
    groups = simhash.near_duplicates(results[1]).collect()
    assert set(ids[2]) == {r["component_id"] for r in groups} and max(ids[2].values()) == 1
    # 3: exactly the clean ones
    checked = contamination.contamination(results[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert set(ids[3]) == {r["doc_id"] for r in checked if not r["contaminated"]}
    # 4: as often as the mix says
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(results[3]).collect()}
    assert ids[4] == Counter({d: n for d, n in copies.items() if n})
    # 5: one digest per row, starts in a row
    digests = sorted(results[5].select("start", "n_tokens").collect())
    assert ids[5] == ids[4] and digests[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(digests, digests[1:]))
