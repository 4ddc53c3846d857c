from pyspark.sql import functions as F

from docloom.functions import keys


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row.r for row in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_new_document_key_golden_value(spark):
    df = spark.createDataFrame([("[name] some 2022 info", "18Ds2syb04"), ("Été (x)\n", "q")], "t string, i string")
    got = [r[0] for r in df.select(keys.new_doc_key(F.col("t"), F.col("i"))).collect()]
    assert got == ["name_some_2022_info___18Ds2syb04", "été_x___q"]


def test_key_parts_drop_trailing_empty_parts(spark):
    values = ["a", "a___1", "t___f___3", "t___f___c___4", "a___b___", "a____", "___x___1", "___", ""]
    assert column(spark, values, keys.key_parts) == [
        ["a"], ["a", "1"], ["t", "f", "3"], ["t", "f", "c", "4"], ["a", "b"], ["a", "_"], ["", "x", "1"], [], [""],
    ]


def test_document_file_and_owner_of_a_key(spark):
    values = ["https://x/a.pdf___0", "title___f1___0", "title___f1___12"]
    assert column(spark, values, keys.doc_key) == ["https://x/a.pdf", "title___f1", "title___f1"]
    assert column(spark, values, keys.file_id) == ["", "f1", "f1"]
    assert column(spark, values, keys.owner) == ["https://x/a.pdf", "f1", "f1"]


def test_ids_of_shared_links(spark):
    values = [
        "https://docs.google.com/document/d/some_made_up_id",
        "https://docs.google.com/presentation/u/0/presentation/d/p1/edit?usp=sharing#x",
        "https://docs.google.com/spreadsheets/d/s1",
        "https://drive.google.com/drive/folders/f1?x=/document/d/no",
        "https://docs.google.com/document/d/",
        "https://docs.google.com/document/d//x",
        "https://example.com/other/path",
        "bare-id",
        "http://host:port/document/d/x",
    ]
    assert column(spark, values, keys.id_from_url_or_id) == [
        "some_made_up_id", "p1", "s1", "f1", None, None, None, "bare-id", "http://host:port/document/d/x",
    ]
    assert column(spark, values[-2:], keys.is_url) == [False, False]
