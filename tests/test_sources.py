import json

import pytest
from pyspark.sql import functions as F

from loomsift.functions.samples import Sample
from loomsift.sources import readers
from loomsift.sources.build import common_prefix, ingest, ingest_all, normalized_turns, parse_turns, unknown_roles
from loomsift.sources.detect import detect
from loomsift.sources.readers import Source


def lines(path, *rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows))
    return str(path)


def read(spark, path, **options):
    good, bad, found = ingest(spark, Source(str(path), **options))
    return good.orderBy("_seq").collect(), bad.orderBy("_seq").collect(), found


CHAT = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}, {"role": "user", "content": "u2"}]


@pytest.mark.parametrize(
    ("row", "task", "want"),
    [
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction_following", {"instruction": "i", "input": "x", "output": "o"}),
        ({"query": "i", "answer": "o", "topic": "t"}, "instruction_following", {"instruction": "i", "output": "o"}),
        ({"prompt": "i", "completion": "o"}, "instruction_following", {"instruction": "i", "output": "o"}),
        ({"messages": CHAT}, "conversational", {"instruction": "u", "output": "a"}),
        ({"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}, "conversational", {"instruction": "u", "output": "a"}),
        ({"prompt": "i", "chosen": "c", "rejected": "r"}, "preference", {"instruction": "i", "chosen": "c", "rejected": "r"}),
        ({"instruction": "i", "output": "o", "label": True}, "unpaired_preference", {"label": 1.0}),
        ({"prompt": "i", "response": "o", "score": 0.87}, "unpaired_preference", {"label": 0.87}),
        ({"prompt": "i", "responses": ["a", "b"], "rewards": [1, "bad"]}, "grpo", {"responses": ["a", "b"], "reward_scores": [1.0, 0.0]}),
        ({"text": "t"}, "language_modeling", {"output": "t"}),
        ({"prompt": "i"}, "prompt_only", {"instruction": "i"}),
    ],
)
def test_formats(spark, tmp_path, row, task, want):
    good, bad, _ = read(spark, lines(tmp_path / "x.jsonl", row, row))
    assert len(good) == 2 and not bad and good[0].task_type == task
    assert {k: good[0][k] for k in want} == want
    assert good[0].id != good[1].id and good[0].provenance_chain[0].step_name == "Connector"
    if "topic" in row:
        assert json.loads(good[0].metadata)["topic"] == "t"
    if "messages" in row:
        assert json.loads(good[0].metadata)["system_prompt"] == "s" and json.loads(good[0].metadata)["turns"] == [{"role": "user", "content": "u2"}]


def test_implicit_preference(spark, tmp_path):
    shared = [{"role": "user", "content": "q"}]
    row = {"chosen": [*shared, {"role": "assistant", "content": "good"}], "rejected": [*shared, {"role": "assistant", "content": "bad"}]}
    good, _, found = read(spark, lines(tmp_path / "x.jsonl", row))
    assert found.format == "implicit_preference" and json.loads(good[0].instruction) == shared
    assert json.loads(good[0].chosen)[1]["content"] == "good"


def test_unknown_rows_are_rejected_once(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", *({"foo": str(i), "baz": "x"} for i in range(25)))
    good, bad, _ = read(spark, path)
    assert not good and [r.rejection_reason for r in bad] == ["unrecognized_format:no_known_column_pattern"] * 25
    assert json.loads(bad[3].metadata)["raw_preview"] == {"foo": "3", "baz": "x"}
    assert read(spark, path, format="nonsense")[1][0].rejection_reason == "invalid_forced_format:nonsense"


def test_jsonl_loses_no_line(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", {"text": "a"}, "", '{"text": "b', {"text": "c", "id": "own", "source_uri": "s"})
    good, bad, _ = read(spark, path)
    assert [(r.output, r._seq) for r in good] == [("a", 1), ("c", 4)]
    assert good[1].id == "own" and good[1].source_uri == "s"
    assert len(bad) == 1 and bad[0].rejection_reason.startswith("json_decode_error:")
    assert read(spark, lines(tmp_path / "e.jsonl"))[:2] == ([], [])


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", *({"text": f"{i} {'w' * 50}"} for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = readers.read_jsonl(spark, path)
        assert rows.rdd.getNumPartitions() > 4
        assert all(json.loads(r.raw)["text"].startswith(f"{r.line - 1} ") for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("body", "n", "reason"), [('[{"text": "a"}, {"text": "b"}]', 2, None), ('{"data": [{"text": "a"}]}', 1, None), ('{"mine": [{"text": "a"}, 3]}', 1, "json_decode_error:record_is_int_not_dict"), ('{"text": "a"}', 1, None), ("[1", 0, "json_decode_error"), ("3", 0, None)])
def test_json_envelopes(spark, tmp_path, body, n, reason):
    (tmp_path / "x.json").write_text(body)
    good, bad, _ = read(spark, tmp_path / "x.json")
    assert len(good) == n and [r.rejection_reason.startswith(reason) for r in bad] == [True] * bool(reason)


def test_csv(spark, tmp_path):
    turns = json.dumps([{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]).replace('"', '""')
    (tmp_path / "x.csv").write_text(f'messages,topic\n"{turns}",\n')
    good, _, _ = read(spark, tmp_path / "x.csv")
    assert (good[0].instruction, good[0].output, good[0].task_type) == ("u", "a", "conversational")
    (tmp_path / "y.tsv").write_text("instruction\toutput\nwhat, now\tsays \"x\" here\n")
    good, _, _ = read(spark, tmp_path / "y.tsv")
    assert (good[0].instruction, good[0].output) == ("what, now", 'says "x" here')
    assert readers.sniff("a|b\n1|2\n") == "|"


def test_parquet_projection(spark, tmp_path):
    spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "text string, note string, n int").coalesce(1).write.parquet(str(tmp_path / "x.parquet"))
    good, _, _ = read(spark, tmp_path / "x.parquet")
    assert [r.output for r in good] == ["a", "b"] and json.loads(good[0].metadata) == {"note": "", "n": "1"}
    plan = readers.read_parquet(spark, str(tmp_path / "x.parquet"), ["text"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string," in plan and "note" not in plan.split("ReadSchema:")[1]


def test_mapping_and_preprocessing(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", {"a": {"b": "deep"}, "out": "o", "n": 1}, {"a": {}, "out": "p", "n": 2})
    good, _, _ = read(spark, path, field_mapping={"a.b": "instruction", "out": "output"})
    assert (good[0].instruction, good[0].output) == ("deep", "o")

    def fn(row):
        if row["n"] == 2:
            raise KeyError("two")
        return {"text": row["out"]}

    good, bad, _ = read(spark, path, preprocessing_fn=fn)
    assert good[0].output == "o" and bad[0].rejection_reason == "preprocessing_fn_error:'two'"
    _, bad, _ = read(spark, path, preprocessing_fn=lambda _: None)
    assert {r.rejection_reason for r in bad} == {"preprocessing_fn_returned_none"}


def test_caps_and_union(spark, tmp_path):
    one = lines(tmp_path / "a.jsonl", *({"text": f"a{i}"} for i in range(5)), "{")
    two = lines(tmp_path / "b.jsonl", {"instruction": "i", "output": "o"})
    good, bad = ingest_all(spark, [Source.of({"name": one, "max_samples": 2}), Source.of(two)])
    assert [r.output for r in good.orderBy("_seq").collect()] == ["a0", "a1", "o"] and bad.count() == 1


def test_roles(spark):
    df = spark.createDataFrame([('[{"from":" Human ","value":"x","weight":"1"},{"role":"bot","content":"y"},{"role":"Oracle","content":"z"}]',)], "t string").select(parse_turns(F.col("t")).alias("t"))
    turns = df.select("t", unknown_roles(F.col("t")).alias("w")).first()
    assert [(t.role, t.content) for t in turns.t] == [("user", "x"), ("assistant", "y"), ("oracle", "z")]
    assert json.loads(turns.t[0].extra) == {"weight": "1"} and turns.w == ["turn_2:unknown_role:oracle"]
    assert normalized_turns is not None


def test_common_prefix(spark):
    t = "array<struct<role:string,content:string>>"
    cases = [([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")], 1), ([("user", "a")], [("user", "a"), ("user", "b")], 1), ([("user", "a")], [("user", "b")], 0), ([], [("user", "a")], 0)]
    df = spark.createDataFrame(cases, f"a {t}, b {t}, n int").select("n", F.size(common_prefix(F.col("a"), F.col("b"))).alias("m"))
    assert all(r.n == r.m for r in df.collect())


def test_detection_priority():
    assert detect([{"chosen": "a", "rejected": "b", "prompt": "p", "label": 1}]).format == "preference"
    assert detect([{"instruction": "a", "output": "b", "label": 1}]).format == "unpaired_preference"
    assert detect([{"instruction": "a", "output": "b"}]).confidence == "high"
    assert detect([{"query": "a", "answer": "b"}]).confidence == "medium"


def parts(spark, tmp_path, kind, n, **columns):
    """n files of rows 0 to 4, 5 to 9, …, named in another order than they are written."""
    folder = tmp_path / f"many.{kind}"
    folder.mkdir()
    for k in range(n):
        rows = [{"text": f"t{i}", **{c: f(i) for c, f in columns.items()}} for i in range(5 * k, 5 * k + 5)]
        name = folder / f"{k}.{kind}"
        if kind == "json":
            name.write_text(json.dumps({"data": [*rows, 3]}))
        elif kind == "jsonl":
            lines(name, *rows, "{")
        elif kind == "csv":
            name.write_text("\n".join([",".join(rows[0]), *(",".join(map(str, r.values())) for r in rows)]) + "\n")
        else:
            spark.createDataFrame(rows).coalesce(1).write.parquet(str(folder / f"f{k}"))
    return str(folder / "*") if kind == "parquet" else str(folder)


@pytest.mark.parametrize("with_id", [False, True])
@pytest.mark.parametrize(("kind", "n"), [("parquet", 4), ("json", 3), ("jsonl", 3), ("csv", 3)])
def test_files_of_one_source(spark, tmp_path, kind, n, with_id):
    path = parts(spark, tmp_path, kind, n, **({"id": lambda i: f"own{i}"} if with_id else {}))
    made = {"parquet": lambda: readers.read_parquet(spark, path), "json": lambda: readers.read_json(spark, path), "jsonl": lambda: readers.read_jsonl(spark, path), "csv": lambda: readers.read_csv(spark, path)}[kind]
    source = Source(path)
    source.rows = lambda _: made()
    good, bad, _ = ingest(spark, source, 3)
    rows = good.orderBy("_seq").collect()
    assert [r.output for r in rows] == [f"t{i}" for i in range(5 * n)]
    assert len({r.id for r in rows}) == len({r._seq for r in rows}) == 5 * n
    if with_id:
        assert [r.id for r in rows] == [f"own{i}" for i in range(5 * n)]
    first = {"csv": 2}.get(kind, 1)
    assert [json.loads(r.provenance_chain[0].notes)["line_number"] for r in rows] == [first + i % 5 for i in range(5 * n)]
    assert bad.count() == (n if kind in ("json", "jsonl") else 0)
    assert all(json.loads(r.metadata)["line_number"] == 6 for r in bad.collect())
    assert len({r._seq for r in bad.collect()} | {r._seq for r in rows}) == bad.count() + 5 * n


def test_finished_samples_bypass_detection(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", {"foo": 1}, {"foo": 2}, {"foo": 3})

    def fn(row):
        if row["foo"] == 3:
            return row
        return Sample(instruction=f"i{row['foo']}", output="o", task_type="grpo", responses=["a", "b"], label=0.5, metadata={"k": row["foo"]}, **({"id": "own"} if row["foo"] == 2 else {}))

    good, bad, _ = read(spark, path, preprocessing_fn=fn)
    assert [(r.instruction, r.output, r.task_type, r.responses, r.label, json.loads(r.metadata)) for r in good] == [(f"i{k}", "o", "grpo", ["a", "b"], 0.5, {"k": k}) for k in (1, 2)]
    assert good[1].id == "own" and good[0].id and good[0].reward_scores == []
    assert [r.rejection_reason for r in bad] == ["unrecognized_format:no_known_column_pattern"]
