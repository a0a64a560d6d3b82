"""Evaluation logs against a plain reading, in any split; order states as a stream; profiles, resolution."""

import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import literals as L
from loomfold.operators import profile as P
from loomfold.sources import evaluation_logs as E
from loomfold.streaming import states

LOG = """Công bố: abc
📐 Công thức: too early
=== RESULTS FOR hybrid: 1 ===
[12:00] Recall@5: 0.1
  Recall@10:   0.25 (n = 4)
  📐 Công thức: hits / relevant : all\x20\x20
🧮 Ví dụ áp dụng: 1 / 4 = 0.25

NDCG@10: 1_0e-1\tx
share: 95%
- 📐 Công thức: dcg / idcg
EVALUATING Recall@10: 7
Coverage : .5
Ví dụ áp dụng: 3 of 6
: 4
📐 Công thức: of nothing
time: -inf
Recall@10: nan
🧮 Ví dụ áp dụng:
Recall@10: 0.5
blank:
"""


def plain(text):
    """The rules one line after the other: {name: [value, formula, example]}."""
    found, current = {}, None
    for line in map(str.strip, re.split("\r\n|\r|\n", text)):
        if not line or line[:3] == "===" or line[0] == "[" or "EVALUATING" in line or "RESULTS FOR" in line:
            continue
        name, mark, rest = line.partition(":")
        if mark and line[0] not in "📐🧮":
            try:
                value = float((rest.split() or [""])[0])
                current = name.strip()
                found.setdefault(current, [None, None, None])[0] = value
            except ValueError:
                pass
        for i, said in ((1, E.FORMULA), (2, E.EXAMPLE)):
            if said in line and current:
                found[current][i] = line.split(said, 1)[1].strip()
    return found


def parsed(spark, path):
    return {(r.log, r.name): [repr(r.value), r.formula, r.example] for r in E.parse(E.read_lines(spark, str(path))).collect()}


@pytest.mark.parametrize("block", [1 << 27, 300, 64])
def test_logs_in_any_split(spark, tmp_path, block):
    texts = {"hybrid": LOG, "gnn": LOG.replace("\n", "\r\n").replace("0.5", "0.75"), "long": "".join(f"m{i % 13}: {i}\n" + "[x]\n" * (i % 40) + f"📐 Công thức: {i}\n" for i in range(300)), "empty": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.log").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert block > 300 or E.read_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 16
        got = parsed(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(log, name): [repr(v[0]), *v[1:]] for log, text in texts.items() for name, v in plain(text).items()}
    assert got == want and len(want) > 20


def test_logs_written_in_parts(spark, tmp_path):
    lines = spark.range(4000).select(F.when(F.col("id") % 4 < 3, "a").otherwise("b").alias("model"), F.col("id").alias("place"),
                                     F.when(F.col("id") % 40 < 2, F.concat(F.lit("m"), (F.col("id") % 7).cast("string"), F.lit(": "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("📐 Công thức: "), F.col("id").cast("string"))).alias("line"))
    E.write(lines, str(tmp_path / "logs"))
    rows = lines.orderBy("place").collect()
    want = {(m, n): [repr(v[0]), *v[1:]] for m in "ab" for n, v in plain("\n".join(r.line for r in rows if r.model == m)).items()}
    assert parsed(spark, tmp_path / "logs") == want


MOVES = [(1, "paid", "2024-01-02"), (1, "paid", "2024-01-05"), (1, "cancelled", "2024-01-03"), (2, "delivered", "2024-02-01"), (2, "delivered", "2024-02-01"),
         (3, "packed", "2024-02-01"), (9, "paid", "2024-02-01"), (None, "paid", "2024-02-01"), (4, "delivered", None), (4, None, "2024-02-02")]


def moves(spark, rows):
    return spark.createDataFrame(rows, "order_id long, move string, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_order_states(spark):
    orders = spark.createDataFrame([(i, "2024-01-04") for i in (1, 2, 3, 4)], "order_id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.order_id: [None if x is None else str(x)[:10] for x in r[1:]] for r in states.settled(orders, states.order_states(moves(spark, MOVES))).collect()}
    no = "False"
    assert got == {
        1: ["True", no, "True", "2024-01-05", None, "2024-01-05", None],
        2: [no, "True", no, None, "2024-02-01", "2024-02-01", None],
        3: [no, no, no, None, None, "2024-01-04", None],
        4: [no, "True", no, None, None, "2024-01-04", None],
        9: [None, None, None, None, None, None, "Order does"],
    }


def test_states_of_a_stream_in_any_order(spark, tmp_path):
    for turn, rows in enumerate((MOVES, MOVES[::-1])):
        for part in range(5):
            moves(spark, rows[part * 2:part * 2 + 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{turn}"))
        stream = spark.readStream.schema("order_id long, move string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{turn}"))
        started = states.order_states(stream).writeStream.outputMode("complete").format("memory").queryName(f"states{turn}").option("checkpointLocation", str(tmp_path / f"at{turn}")).trigger(availableNow=True).start()
        assert started.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"states{turn}").collect())) == sorted(map(tuple, states.order_states(moves(spark, MOVES)).collect()))


def test_latest_interactions_of_a_stream(spark, tmp_path):
    rows = [("u", "p1", "view", "2024-01-01"), ("u", "p3", "like", "2024-01-03"), ("u", "p2", "like", "2024-01-03"), ("v", None, "view", "2024-01-01")]
    table = spark.createDataFrame(rows, "user_id string, product_id string, interaction_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    started = states.latest_of_each(stream).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert started.awaitTermination(120)
    assert sorted(r[:3] for r in spark.table("latest").collect()) == [("u", "p3", "like"), ("v", None, "view")]


def test_profile_of_awkward_columns(spark):
    cells = [("1", "1.5", "TRUE", " ", None, "x"), ("-2", "7", "false", "", None, "1"), (" 30 ", "-1e2", None, None, None, "1"), ("4", "", " true ", "", None, "y")]
    got = {r.column: r for r in P.profile(spark.createDataFrame(cells, "a string, b string, c string, d string, e string, f string")).collect()}
    assert [got[c].type for c in "abcdef"] == ["integer", "number", "boolean", "empty", "empty", "text"]
    assert [(got[c].nulls, got[c].blanks, got[c].null_share) for c in "abcdef"] == [(0, 0, 0.0), (0, 1, 0.25), (1, 0, 0.25), (1, 3, 1.0), (4, 0, 1.0), (0, 0, 0.0)]
    assert (got["a"].mean, got["a"].least, got["a"].most, got["f"].mean, got["f"].about_distinct) == (8.25, -2.0, 30.0, None, 3)
    empty = P.profile(spark.createDataFrame([], "x string, y long")).collect()
    assert [(r.column, r.type, r.rows, r.null_share, r.about_distinct, r.about_quarters) for r in empty] == [(c, "empty", 0, 0.0, 0, None) for c in "xy"]


def test_sketches_within_their_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 50_000).alias("few"), (F.col("id") * F.col("id") / 1e6).alias("bent"))
    got = {r.column: r for r in P.profile(rows.repartition(16)).collect()}
    assert abs(got["few"].about_distinct / 50_000 - 1) < 0.03 and abs(got["bent"].about_distinct / 200_000 - 1) < 0.03
    for share, said in zip(P.QUARTERS, got["bent"].about_quarters):
        assert abs((said * 1e6) ** 0.5 / 200_000 - share) < 0.02


def test_resolved(spark):
    entities = spark.createDataFrame([("a", 7, None), ("b", None, "0123456789abcdef01234567"), ("c", 12, "1" * 24), ("d", None, None)], "entity_id string, number long, object_id string")
    asked = ["007", "7", " 7", "7.0", "0123456789ABCDEF01234567", "1" * 24, "1" * 23, "", None, "12", "99999999999999999999", "g" * 24, "7"]
    got = P.resolved(spark.createDataFrame([(x,) for x in asked], "asked string"), entities, "asked").collect()
    want = dict(zip(asked, ["a", "a", None, None, "b", "c", None, None, None, "c", None, None]))
    assert len(got) == len(asked) and all(r.entity_id == want[r.asked] and (r.error is None) == (r.entity_id is not None) for r in got)


def test_iso_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02 03:04", "2024-01-02T03:04:05.123456-02:00", "2024-01-02T03:04:05.123+0530", "2024-01-02", "2024-01-02T03", "", None, "soon", "2024-02-30", "2024-01-02T25:00:00Z", "2024-01-02T03:04:05,5Z"]
    now = datetime(2000, 1, 1, tzinfo=timezone.utc)

    def said(text):
        try:
            at = datetime.fromisoformat(text.replace("Z", "+00:00"))
            return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        except (ValueError, AttributeError):
            return now

    rows = spark.createDataFrame([(t,) for t in texts[:-1]], "t string").select("t", F.unix_micros(C.iso_time(F.col("t"), F.to_timestamp(F.lit("2000-01-01")))).alias("m")).collect()
    assert {r.t: r.m for r in rows} == {t: round(said(t).timestamp() * 1e6) for t in texts[:-1]}


def test_first_images(spark):
    cells = {"['a', 'b']": "a", " [\"it's\"] ": "it's", "[": None, "[]": None, "['a' 'b']": "ab", "[None, 'a']": None, " http://z ": "http://z", "[http://z]": None, "('a',)": None, "": None, None: None}
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", C.first_image(F.col("c"), L.as_json(F.trim("c"))).alias("url")).collect()
    assert {r.c: r.url for r in rows} == cells


def test_exports_that_lost_rows(spark):
    one = lambda n: spark.createDataFrame([(n,)], "rows long")
    got = P.export_result({"a": one(3), "b": one(4)}, {"a": one(3), "b": one(5)}).collect()
    assert [tuple(r) for r in got] == [("a", 3, True), ("b", 4, False), ("all", 7, False)]
