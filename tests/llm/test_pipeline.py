"""The pipeline's stages on the smallest tables, each against a plain version on its own input, and run() against their chain."""

import collections

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from airgrid.llm import bpe, pii, toxicity
from test_operators import plain_targets, plain_toxicity, words_of


def plain_survivors(rows):
    """Ids that stay: the smallest of each component of texts whose sets of five-word shingles are alike to 0.8."""
    sets = {}
    for i, t in rows:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in words_of(t)]
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i for i in ids if top(i) == i}


def plain_redaction(text, spans):
    out, end = "", 0
    for kind, start, stop in spans:
        if start >= end:
            out += text[end:start] + f"<{kind.upper()}>"
        end = max(end, stop)
    return out + text[end:]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        stages[name] = docs = spark.read.parquet(str(tmp_path / name))
        assert name == "tokens" or docs.columns == stages["documents"].columns
    rows = {name: df.collect() for name, df in stages.items()}

    model = toxicity.fit(stages["documents"], labels)
    scores = {r.doc_id: (plain_toxicity(model, r.text or ""), model.by_language.get(r.lang, model.threshold)) for r in rows["documents"]}
    kept = {r.doc_id for r in rows["toxicity"]}
    assert all((i in kept) == (s < limit) for i, (s, limit) in scores.items() if abs(s - limit) > 1e-5)
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert len(toxic & kept) < len(toxic) / 2 and len(kept - toxic) >= 0.95 * len(scores.keys() - toxic)

    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted(plain_survivors([(r.doc_id, r.text) for r in rows["toxicity"]]))

    found = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
             for r in pii.find_spans(stages["near_duplicates"]).collect()}
    want = {r.doc_id: plain_redaction(r.text or "", found[r.doc_id]) for r in rows["near_duplicates"]}
    assert {r.doc_id: r.text or "" for r in rows["personal_data"]} == want and any(found.values())

    sizes, longest = collections.Counter(), collections.Counter()
    for r in rows["personal_data"]:
        n = len(words_of(r.text))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    taken = collections.Counter()
    for r in rows["mixing"]:
        taken[r.source] += len(words_of(r.text))
    assert all(abs(taken[s] - t) <= longest[s] for s, t in plain_targets(sizes).items())
    texts = {r.doc_id: r.text for r in rows["personal_data"]}
    copies = collections.Counter(r.doc_id for r in rows["mixing"])
    assert max(copies.values()) <= 2 and all(texts[r.doc_id] == r.text for r in rows["mixing"])

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert collections.Counter(r.doc_id for r in rows["tokens"]) == copies
    for r in rows["tokens"]:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.text == texts[r.doc_id] and np.min(r.ids) >= 0

    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, rows["tokens"]))


def test_toxicity_stage_after_many_steps(spark, sf_dir, monkeypatch):
    """With the steps of a large training behind it, the stage failed as steps x rows no longer fit 64 bits."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), toxicity.Training.__init__

    def late(self, model, share):
        start(self, model, share)
        self.step = 1e9

    monkeypatch.setattr(toxicity.Training, "__init__", late)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf_dir).select("doc_id").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    assert len(toxic & kept) < len(toxic) / 2 and len(kept - toxic) >= 0.9 * (docs.count() - len(toxic))
