"""Work that must not change its form, or grow faster than the input, on larger tables."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from airgrid.llm import bpe, toxicity


def test_training_states_grow_slower_than_rows(spark, monkeypatch):
    assert [toxicity.training_tasks(n) for n in (0, 5, 12_000, 76_842, 96_000)] == [1, 1, 2, 12, 16]
    assert toxicity.training_tasks(96_000 * 100) == 160
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "materialize", lambda df: df)
    rows = toxicity.labelled(docs, labels, "toxic", toxicity.F.lit(True))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows.count() == 20


def test_workers_hold_little_text_at_once(spark):
    docs = spark.range(0, 30, 1, 1).selectExpr("id as doc_id", "repeat('word ', 40000) as text")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def make(codec, part: pa.RecordBatch) -> pa.RecordBatch:
        held = pc.sum(pc.binary_length(part.column("text"))).as_py()
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(part.num_rows, held, np.int64))], names=["doc_id", "held"])

    rows = bpe._over(docs, ranks, public_tokenizers.PATTERN, ("doc_id", "text"), "doc_id long, held long", make).collect()
    assert len(rows) == 30 and max(r.held for r in rows) <= 1 << 20
    model = toxicity._start_model(np.zeros((2, toxicity.TABLES, toxicity.BUCKETS)), 0, 0, 6, 8, np.random.default_rng(0))
    scored = toxicity.score(docs, model, ("doc_id", "text"), "__toxic")
    sent = scored._jdf.queryExecution().analyzed().children().head().output()
    assert sent.size() == 2  # a kept text isn't sent twice
    assert scored.columns == ["doc_id", "text", "__toxic"] and scored.count() == 30


def test_sums_of_states_fit_after_many_steps(spark, tmp_path, monkeypatch):
    """Steps x rows x the unit of the sums went over 64 bits in a few rounds over 4 GB: an error, or in one task a wrong step."""
    made, start = [], toxicity.Training.__init__

    def late(self, model, share):
        start(self, model, share)
        self.step = 1e8
        made.append(self)

    monkeypatch.setattr(toxicity.Training, "__init__", late)
    words = [(bytearray(toxicity.hashed_words(b"good word" if i % 2 else b"bad word").tobytes()), i % 2) for i in range(80)]
    spark.createDataFrame(words, "words binary, label int").repartition(4).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for tasks in (1, 4):
        monkeypatch.setattr(toxicity, "training_tasks", lambda n, tasks=tasks: tasks)
        model = toxicity.train(rows)
        steps = made[-1].step - 1e8
        assert 6 <= steps <= 36  # in each of 6 rounds one step per 32 rows or part of a batch
        scores = model.scores([toxicity.hashed_words(t) for t in (b"good word", b"bad word")])
        assert np.isfinite(scores).all() and scores[0] > scores[1]


def test_states_are_summed_exactly():
    rng = np.random.default_rng(3)
    tasks = []
    for done in (18_750, 60_000, 1):
        places = np.sort(rng.choice(50, 30, replace=False))
        kinds = np.repeat(np.arange(toxicity.WHOLE), 30)
        values = rng.normal(0, 1, (len(kinds), 7)) * 10.0 ** rng.integers(-9, 6, (len(kinds), 1))
        values[0, :3] = 0.5, -1.5, 2.0 ** -33
        tasks.append((kinds, np.tile(places, toxicity.WHOLE), values, done))
    exact, weight, sums, sent = {}, {}, {}, {}
    for kinds, places, values, done in tasks:
        for k, p, v in zip(kinds, places, values, strict=True):
            exact[k, p] = [a + round(float(x) * 2 ** 32) * done for a, x in zip(exact.get((k, p), [0] * 7), v, strict=True)]
            weight[k, p] = weight.get((k, p), 0) + done
        for k, p, v in zip(*toxicity.split(kinds, places, values), strict=True):
            assert abs(v).max() <= 1 << 31
            sums[k, p] = sums.get((k, p), 0) + v * done
            sent[k, p] = sent.get((k, p), 0) + done
    keys = list(sums)[::-1]  # the order of the sums is open
    kinds, places, total, n = toxicity.united(*(np.array(x) for x in zip(*keys, strict=True)), list(np.array([sums[k] for k in keys]).T), np.array([sent[k] for k in keys]))
    assert len(kinds) == len(exact)
    for k, p, v, m in zip(kinds, places, total, n, strict=True):
        assert v.tolist() == [float(x) for x in exact[k, p]] and m == weight[k, p]
