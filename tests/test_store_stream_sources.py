import json

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import dialogs, store
from lexiflow.sources import readers, sinks
from lexiflow.sources.feed import FeedSource, parse_feed
from lexiflow.streaming.news_loop import NewsLoop, deduplicated

KV = "k string, v int, made int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keyed_changes(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], KV)
    new = spark.createDataFrame([("b", 20, 9), ("b", 21, 9), ("c", 30, 9), (None, 5, 9)], KV)
    assert rows(store.dedupe_first(new, ["k"], ["v"])) == [("b", 20, 9), ("c", 30, 9)]
    assert rows(store.insert_ignore(old, new, ["k"], ["v"])) == [("a", 1, 1), ("b", 2, 1), ("c", 30, 9)]
    after = store.upsert(old, new, ["k"], ["v"], keep=("made",))
    assert rows(after) == [("a", 1, 1), ("b", 20, 1), ("c", 30, 9)]
    assert rows(store.upsert(after, new, ["k"], ["v"], keep=("made",))) == rows(after)
    assert rows(store.bulk_update(old, new.select("k", "v"), ["k"], ["v"])) == [("a", 1, 1), ("b", 20, 1)]
    assert rows(store.delete_keys(old, new.select("k"))) == [("a", 1, 1)]
    assert rows(store.delete_where(old, F.col("v") > 1, F.col("made") == 1)) == [("a", 1, 1)]
    assert rows(store.update_where(old, F.col("k") == "a", {"v": F.lit(7)})) == [("a", 7, 1), ("b", 2, 1)]
    empty = spark.createDataFrame([], KV)
    assert rows(store.upsert(empty, empty, ["k"], ["v"])) == []


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1)], KV)
    store.write_version(df, str(tmp_path / "t"), 1)
    with pytest.raises(Exception):
        store.write_version(df, str(tmp_path / "t"), 1)


def test_json_sources(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\nbroken\n{"b": 2}\n', encoding="utf-8")
    assert readers.json_lines(spark, str(path), "a int").count() == 2
    kept = readers.json_lines(spark, str(path), "a int", bad="keep").cache()
    assert kept.where("_corrupt is not null").count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(path), "a int", bad="fail").collect()
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps({"content": "x"}), encoding="utf-8")
    assert readers.json_documents(spark, str(doc), "content string, name string", {"name": "?"}).first().name == "?"


def test_text_tree_and_encodings(spark, tmp_path):
    text = "Съешь ещё этих мягких французских булок, да выпей же чаю. " * 20
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(text.encode("cp1251"))
    (tmp_path / "b.txt").write_bytes(text.encode("iso8859-5"))
    (tmp_path / "sub" / "c.TXT").write_bytes(b"\xef\xbb\xbf" + text.replace(". ", ".\r\n").encode())
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.decoded_tree(spark, str(tmp_path)).collect()}
    assert got["a.txt"].encoding == "cp1251" and got["a.txt"].text == text
    assert got["b.txt"].encoding == "iso8859-5" and got["b.txt"].text == text
    tree = {r.path.rsplit("/", 1)[1]: r.text for r in readers.text_tree(spark, str(tmp_path / "sub")).collect()}
    assert tree["c.TXT"] == text.replace(". ", ".\n")
    assert readers.inventory(spark, str(tmp_path)).count() == 3


def test_first_existing(spark):
    files = spark.createDataFrame([("v1b",), ("v2a",)], "path string")
    wanted = spark.createDataFrame([(1, "v1a", 0), (1, "v1b", 1), (2, "v2a", 0), (2, "v2b", 1), (3, "x", 0)], "volume int, path string, priority int")
    assert rows(readers.first_existing(files, wanted)) == [(1, "v1b"), (2, "v2a")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("ё", None)], "a string, b int")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert rows(readers.json_lines(spark, str(tmp_path / "j"), "a string, b int")) == [("ё", None)]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(readers.csv_table(spark, str(tmp_path / "c"), "a string, b int")) == [("ё", None)]
    sinks.write_report(df, str(tmp_path / "r"), "%s!", "a")
    assert spark.read.text(str(tmp_path / "r")).first().value == "ё!"


FEED = """<rss><channel><item><title>Т</title><link>http://x/1</link><description></description><pubDate>Mon, 06 May 2024 10:00:00 +0000</pubDate></item><item><title>без ссылки</title></item></channel></rss>"""


def test_feed(spark, tmp_path):
    assert len(parse_feed(FEED, "s")) == 1 and parse_feed("<rss", "s") == []
    (tmp_path / "tass.xml").write_text(FEED, encoding="utf-8")
    spark.dataSource.register(FeedSource)
    r = spark.read.format("feed").option("path", str(tmp_path)).load().first()
    assert (r.title, r.content, r.source) == ("Т", "Т", "tass")


def test_prompts_and_models(spark):
    df = spark.createDataFrame([("t", None, "Заголовок: А\nТекст: Б")], "title string, content string, input string")
    assert df.select(dialogs.content_of(df.columns).alias("x")).first().x == "Б"
    chat = df.select(dialogs.chat_text("s", F.col("title")).alias("x")).first().x
    assert chat.startswith("<|begin_of_text|>") and chat.endswith("assistant<|end_header_id|>\n\n")

    def broken():
        def call(batch):
            raise ValueError("down")

        return call

    r = dialogs.apply_model(df, "title", "out", broken).first()
    assert r.out is None and r.error == "down"


def test_news_loop(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "id string, title string, content string, source string, date timestamp, url string"

    def feed(n, *ids):
        spark.createDataFrame([(i, f"t{i}", "c", "s", None, f"u{i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(str(src))

    sent = []
    model = lambda: lambda batch: ["Достаточно длинный и полный ответ. " if "t1" in b or "t2" in b else "коротко" for b in batch]
    loop = NewsLoop(spark, str(tmp_path / "store"), model, lambda ms: sent.extend(m["news_id"] for m in ms) or [m["news_id"] for m in ms], per_cycle=5)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        loop.start(stream, str(tmp_path / "cp")).awaitTermination()

    feed(1, "1", "3")
    run()
    feed(2, "1", "2")
    run()
    assert sorted(r.id for r in loop.news().collect()) == ["1", "2", "3"]
    assert sorted(sent) == ["1", "2"]
    assert loop.news().where("processed and not analysed").first().id == "3"
    before = dict(loop.counters)
    loop.cycle(spark.createDataFrame([], schema), loop.last_version())
    # Counters are those of the last cycle that ran; each of the two runs published one.
    assert loop.counters == before and loop.counters["published"] == 1


def test_stream_dedup(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "id string").write.parquet(str(tmp_path / "i"))
    q = deduplicated(spark.readStream.schema("id string").parquet(str(tmp_path / "i"))).writeStream.format("memory").queryName("dedup_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup_out").count() == 2


def test_tables_and_plans(spark, tmp_path):
    store.create_table(spark, "made", "a int, b string")
    assert store.run_sql(spark, "SELECT count(*) AS n FROM made WHERE a > :least", least=1).first().n == 0
    store.drop_table(spark, "made")
    assert not spark.catalog.tableExists("made")
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert store.append(rows, rows.select("b", "a")).count() == 4
    assert store.select_where(rows, F.col("a") > 0, F.col("b").isNull(), limit=1).first().a == 2
    plans = []
    assert store.logged(rows.where("a = 2"), plans.append).count() == 1 and "2" in plans[0]


def test_trees_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\ufeffраз\r\nдва".encode())
    (tmp_path / "b.txt").write_bytes("déjà".encode("latin-1"))
    (tmp_path / "c.md").write_text("три")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding) for r in readers.decoded_or_latin(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("раз\nдва", "utf-8"), "b.txt": ("déjà", "latin-1")}
    blocks = readers.concatenated(readers.text_tree(spark, str(tmp_path), ".md")).collect()
    assert blocks[0].block.startswith("=== ") and blocks[0].block.endswith("три\n")


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from lexiflow.session import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda *a: None)
    remote = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="share"):
        ensure_checkpoint_dir(remote)


def test_refused_calls_wait(spark, tmp_path):
    waited, calls, reports = [], [], []

    def publish(messages):
        calls.append(1)
        if len(calls) < 3:
            error = ConnectionError("busy")
            error.retry_after = 7 if len(calls) == 1 else None
            raise error
        return [m["news_id"] for m in messages]

    loop = NewsLoop(spark, str(tmp_path), lambda: lambda prompts: [], publish, sleep=waited.append, report=reports.append)
    assert loop._send([{"news_id": "a"}]) == ["a"] and waited == [7, 4.0]
