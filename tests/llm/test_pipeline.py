"""The pipeline, stage by stage, against plain versions."""

import random
import re

import corpus_pipeline
from brute import WORD, components, mixed
from test_quality import brute as measured

from glosa.llm import pieces, secrets


def corpus():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    out = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        if k % 7 == 0:
            text.insert(3, "password=hunter2hunter2")
        t = " ".join(text) + ("." if k % 2 else " #" * (k % 5))
        out += [(t, rng.choice(["a", "b", None]))] * (1 + (k % 9 == 0))
    return out + [(None, "a"), ("", "b"), ("same five words again here " * 6, "a"), (out[5][0].replace("word1", "word1", 1), "c")]


def weight(text):
    signs = len(re.findall(r"[#*$%&|<>]", text))
    n = len(WORD.findall(text))
    return 0.5 if signs * 20 > n else 2.0 if re.search(r"[.!?]\s*$", text) else 1.0


def test_run(spark, documents, tmp_path):
    rows = corpus()
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = [(i, t, s) for i, (t, s) in enumerate(rows)]
    docs = [d for d in docs if not measured(d[1])[5]]
    docs = [d for d, (_, c) in zip(docs, components([(d[0], d[1]) for d in docs])) if c == d[0]]
    mask = re.compile(secrets.ASSIGN)
    docs = [(i, mask.sub(lambda m: "[secret]" if len(m.group(2)) >= 8 else m.group(), t), s) for i, t, s in docs]
    plan = mixed([(i, s, len(WORD.findall(t)), weight(t)) for i, t, s in docs])
    want = sorted((i, t) for (i, t, s), (_, _, n) in zip(docs, plan) for _ in range(n))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seg = pieces.segmenter(pieces.read_vocabulary(), pieces.N_BEST)
    assert sorted((r["doc_id"], seg.decode(r["ids"])) for r in out) == want
    assert all(r["exact"] for r in out)


def test_stages(spark, documents, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "secret_scans", "mixing", "sentencepiece"]
    docs = documents(corpus())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.collect() == []
