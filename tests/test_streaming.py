from loreweave.streaming.postings import chunk_postings, read_postings, write_postings

SCHEMA = "chunk_id string, title string, heading string, text string, entity_type string, tags_json string, content_hash string"


def test_postings_follow_the_stream(spark, tmp_path, rows):
    def send(i, data):
        spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "in" / f"d={i}"))

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/*"))
        write_postings(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)

    a, b = ("a", "T", None, "one two", "Note", '["x"]', "1"), ("b", "T", None, "three", "Note", None, "2")
    send(0, [a, b, a])
    run()
    assert rows(read_postings(spark, str(tmp_path / "out"))) == rows(chunk_postings(spark.createDataFrame([a, b], SCHEMA)))
    changed, gone = ("a", "T", None, "four", "Note", None, "3"), ("b", None, None, None, None, None, "4")
    send(1, [changed, gone])
    run()
    got = rows(read_postings(spark, str(tmp_path / "out")))
    assert got == rows(chunk_postings(spark.createDataFrame([changed], SCHEMA))) and {r[0] for r in got} == {"a"}
