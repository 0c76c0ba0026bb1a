import pytest
from pyspark.sql import functions as F

from chatterloom.functions import labels as L
from chatterloom.functions import text as T
from chatterloom.operators import annotation as A
from chatterloom.operators import metrics as M
from chatterloom.operators.dense_groups import dense_group_sums
from chatterloom.sources import readers, writers


def value(spark, text, build):
    return spark.createDataFrame([(text,)], "c string").select(build(F.col("c")).alias("r")).first().r


def test_dense_groups(spark):
    rows = [("hot", 1.0)] * 3000 + [(None, None), ("", 2.0), ("a", float("nan"))] + [(f"k{i}", float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: (r.n, r.sum_v, r.cnt_v) for r in dense_group_sums(df, "g", {"v": F.col("v")}).collect()}
    assert got["hot"] == (3000, 3000.0, 3000) and got[None] == (1, 0.0, 0) and got[""] == (1, 2.0, 1) and got["a"] == (1, 0.0, 0) and got["k7"] == (1, 7.0, 1)
    assert len(got) == 504
    assert dense_group_sums(df.limit(0), "g").count() == 0


@pytest.mark.parametrize("text, want", [("see https://a.com/x now", "see  a.com/x now"), ("see https://www.a.com/x now", "see" + 4 * " " + "now"), ("HTTP://a", "HTTP://a")])
def test_url_mask(spark, text, want):
    """The scheme and the www token each become one blank."""
    assert value(spark, text, T.url_mask) == want


@pytest.mark.parametrize(
    "text, build, want",
    [
        ("A + Link / URL, B", T.tokenize_multi, ["A", "B"]), ("a, NA, ,b", T.split_multi, ["a", "b"]), ("nan", T.split_multi, []), (None, T.split_multi, []),
        ("Hi @bob! See https://x.y/z", T.key_fuzzy, "hi <user> see <url>"),
        ("software", L.norm_theme, "Politics"), (" ", L.norm_theme, None),
        ("rumor", lambda c: L.norm_labels(c, L.CLAIM_RULES), ["Rumour / unverified report"]), ("rumor", lambda c: L.norm_labels(c, L.CLAIM_RULES_ABLATION), ["Other claim type"]),
        ("No substantive claim", lambda c: L.norm_labels(c, L.CLAIM_RULES_ABLATION), ["No substantive claim"]),
        ("None", lambda c: L.norm_labels(c, L.CTA_RULES), ["No CTA"]), ("Watch video", lambda c: L.norm_labels(c, L.CTA_RULES), ["Visit external link / watch video"]),
        ("Link/URL, Statistics", lambda c: L.norm_labels(c, L.EVIDENCE_RULES, "link|url"), ["Statistics"]),
        (None, lambda c: L.codebook_field(c, "ctas"), ["No CTA"]), ("zzz", lambda c: L.codebook_field(c, "ctas"), ["No CTA"]),
        ("Announcement, Verifiable factual statement", lambda c: L.enforce(L.codebook_field(c, "claim_types"), "claim_types"), ["Announcement"]),
        ("None / assertion only, Statistics", lambda c: L.enforce(L.codebook_field(c, "evidence"), "evidence"), ["Statistics"]),
        ("Lifestyle & well-being", lambda c: L.codebook_field(c, "theme"), ["Lifestyle & well‑being"]),
        ("M61\ntheme: Sports\nfoo: x", A.parsed_labels, {"theme": "Sports"}),
    ],
)
def test_scalars(spark, text, build, want):
    assert value(spark, text, build) == want


def test_metrics(spark):
    df = spark.createDataFrame([("g", 1, 0.3, 0), ("g", 0, 1.0, 1), ("g", 1, 0.3, 0), ("g", 0, 0.1, 0)], "g string, y int, p double, pred int")
    assert {r.bin for r in M.reliability(df, ["g"]).collect()} == {1, 2}
    assert M.roc_auc(df, ["g"]).first().roc_auc == 0.5
    assert M.roc_auc(df.where("y = 1"), ["g"]).first().roc_auc is None
    assert M.bundle(df.limit(0), ["g"]).count() == 0


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", "d", "x,\"y\"\nz")], "channel string, msg_id string, msg_date string, text string")
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c"), readers.RAW).first().text == 'x,"y"\nz'
    import lzma

    (tmp_path / "r.csv.xz").write_bytes(lzma.compress(b'channel,msg_id,date,text\na,1,,"x,y"\n'))
    row = readers.read_csv_xz(spark, str(tmp_path / "r.csv.xz"), readers.RAW).first()
    assert (row.channel, row.msg_date, row.text) == ("a", None, "x,y")
    writers.append_jsonl(df, str(tmp_path / "j"), 1)
    assert readers.read_jsonl(spark, str(tmp_path / "j"), readers.RAW).count() == 1
    assert writers.markdown(df.select("channel")).endswith("| a |")


def test_stream(spark, tmp_path, data):
    from chatterloom.streaming.monitor import weekly_tail

    src = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = weekly_tail(stream, "ts", "value", 400.0).writeStream.format("memory").queryName("weekly").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("weekly").agg(F.sum("n")).first()[0] == src.count()


def test_noise_has_five_repetitions(spark, data):
    from chatterloom.plans import modelling

    rows = modelling.noise_robustness(spark, data).collect()
    assert {(r.rate, r.rep) for r in rows} == {(x, i) for x in (0.0, 0.05, 0.1, 0.2) for i in range(5)}


def test_release_deletes_staged_tables(spark):
    import os

    from chatterloom import session

    staged = session.stage(spark.range(3).toDF("x"), "three")
    assert staged.count() == 3 and os.path.isdir(session._own_dir(spark))
    session.release(spark)
    assert not os.path.exists(session._own_dir(spark))


def test_latest_answers_in_a_stream(spark, tmp_path):
    from chatterloom.streaming.monitor import latest_answers

    schema = "message_id long, ts timestamp, error string, answer string"
    for i, rows in enumerate(([(1, "2024-01-01 00:00:00", None, "a"), (2, "2024-01-01 00:00:00", "x", "b")], [(1, "2024-01-02 00:00:00", None, "c"), (2, "2024-01-01 00:00:01", None, "d")])):
        spark.createDataFrame(rows, "message_id long, ts string, error string, answer string").write.json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    latest_answers(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("answers").trigger(availableNow=True).start().awaitTermination()
    assert {(r.message_id, r.answer) for r in spark.table("answers").collect()} == {(1, "c"), (2, "d")}


def test_places_of_json_lines(spark, tmp_path):
    from chatterloom.sources.readers import read_json_document, read_jsonl

    (tmp_path / "b.jsonl").write_text('{"x": 3}\n\n{"x": 4}\n')
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    assert [r.x for r in read_jsonl(spark, str(tmp_path), "x int").orderBy("file", "block", "pos").collect()] == [1, 2, 3, 4]
    (tmp_path / "c.json").write_text('[{"x": 5}, {"x": 6}]')
    assert [r.x for r in read_json_document(spark, f"{tmp_path}/c.json", "x int").collect()] == [5, 6]


def test_token_helpers(spark):
    from chatterloom.functions import text as T

    df = spark.createDataFrame([(" a‑b c/d & é ", " x , ,NA,y")], "a string, b string")
    r = df.select(T.sanitize_token(F.col("a")).alias("s"), T.split_plain(F.col("b")).alias("p"), T.token_count(F.col("a")).alias("n")).first()
    assert r.s == "a-b_c/d___é" and r.p == ["x", "NA", "y"] and r.n == 4

