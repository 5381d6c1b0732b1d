"""Columns, dictionaries, SQL functions and streams."""

import random
import re
import tracemalloc
from itertools import accumulate
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from segspark import charsets as C
from segspark import cluster_ends, clusters, load_dict, normalize, register_functions, segment
from segspark.functions.clusters import cluster_rows
from segspark.functions.plain import pieces_of, plain_offsets
from segspark.functions.segment import HELD_CHARS, _batch, _udf, _udf_in_parts, segment_plain, token_offsets
from segspark.operators import dictionary as D
from segspark.operators.lattice import Words, segment_text
from segspark.queries import GOLDEN, MINI_TH
from segspark.sources.wordlist import from_words, stored
from segspark.streaming.streams import token_counts, token_stream

# input, corrected, reference mode
NORMAL = [
    ("เเปลก", "แปลก", None),
    ("นํา", "นำ", None),
    ("นํ้า", "น้ำ", "น\\1ำ"),
    ("นํา้", "น้ำ", "น\\1ำ"),
    ("กำ่", "ก่ำ", "ก\\1ำ"),
    ("ก่ั", "กั่", "ก\\2\\1"),
    ("กู่", "กู่", "ก\\2\\1"),
    ("พันธ์ุ", "พันธุ์", "พันธ\\2\\1"),
    ("นะะะ", "นะ", None),
    ("ก่่่", "ก่", None),
    ("มากกก", "มากกก", None),
    ("ราคา 550.75 บาท", "ราคา 550 . 75 บาท", None),
    ("a  b\t\t\tc\n\n\nd", "a b\tc\nd", None),
    ("a ​ b", "a b", None),
    (None, None, None),
]


def test_normalize(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in NORMAL], "t string").select("t", normalize("t").alias("a"), normalize("t", compat="reference").alias("b"), normalize(normalize("t")).alias("c"), normalize("t", whitespace_number=False).alias("d"))
    for r, (_, a, b) in zip(df.collect(), NORMAL):
        assert (r.a, r.b) == (a, b or a)
    assert spark.range(1).select(normalize(F.lit("ปี2021"))).first()[0] == "ปี 2021 "
    with pytest.raises(ValueError):
        normalize("t", compat="x")


def test_clusters(spark):
    df = spark.createDataFrame([("เรียนต์",), ("",), (None,)], "t string")
    assert [(r.c, r.e) for r in df.select(clusters("t").alias("c"), cluster_ends("t").alias("e")).collect()] == [(["เรียนต", "์"], [6, 7]), ([], []), ([], [])]


def test_ends_of_texts_without_longer_clusters_need_no_clusters(spark, monkeypatch):
    monkeypatch.setattr(C, "CLUSTER", "no such text")
    rows = spark.createDataFrame([("a\u00e9\U0001f600 \u0e32\n",), ("",), (None,)], "t string").select(cluster_ends("t").alias("e")).collect()
    assert [r.e for r in rows] == [[1, 2, 3, 4, 5, 6], [], []]


def test_texts_without_longer_clusters_need_no_pattern(spark, monkeypatch):
    monkeypatch.setattr(C, "CLUSTER", "no such text")
    rows = spark.createDataFrame([("a\u00e9\U0001f600 \u0e32\n",), ("",), (None,)], "t string").select(clusters("t").alias("c")).collect()
    assert [r.c for r in rows] == [[*"a\u00e9\U0001f600 \u0e32\n"], [], []]


def test_clusters_and_ends_on_random_text(spark):
    """Against the pattern of the SQL, on texts with and without Thai."""
    rng = random.Random(5)
    thai = [*"กรขเแโาำะัิีุู็์่้ำ ๑12,a\n฿\U0001f600", "กรรข์ ็", "เริ", "เกียก์"]
    texts = ["".join(rng.choices(p, k=rng.randint(0, 30))) for p in (thai, "ab \u00e9\u0301\U0001f600\r\n๑ๆ่") for _ in range(500)] + [None]
    want = [[y for x in re.findall(C.CLUSTER_PLAIN, t or "") for y in ([x[:-1], x[-1]] if re.search(C.CLUSTER_SPLIT, x) else [x])] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", clusters("t").alias("c"), cluster_ends("t").alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [list(accumulate(map(len, r.c))) for r in got]
    assert [r.c for r in got] == want
    rows = sorted(map(tuple, cluster_rows(df, "i", "t").collect()))
    assert rows == [(r.i, p, c, e) for r in got for p, (c, e) in enumerate(zip(r.c, r.e))]


def test_dictionary_steps(spark):
    words = stored(from_words(spark, ["ศาล"]))
    sizes = []
    for step, w in [(D.add, "ศาล"), (D.add, "  ศาล "), (D.add, "ศาลา"), (D.remove, "ศาลา"), (D.remove, "ลา"), (D.remove, "ศาล"), (D.remove, "")]:
        words = step(words, spark.createDataFrame([(w,)], "word string"))
        sizes.append(D.size(words).first()[0])
    assert sizes == [1, 1, 2, 1, 1, 0, 0]


def test_load_dict(spark, tmp_path):
    p = tmp_path / "words"
    p.write_bytes("กา\r\n  กาแฟ \n\nx\ry\n".encode() + b"\xff\xfe\nok")
    message, ok = load_dict(spark, str(p), "filed")
    assert ok and message == f"Successful: file {p} has been successfully loaded to dictionary name filed."
    assert {r.word for r in D.registry(spark).words("filed").collect()} == {"กา", "กาแฟ", "x\ry", "ok"}
    assert load_dict(spark, str(p), "filed") == ("Failed: dictionary name filed already exists, please use another name.", False)
    with pytest.raises(FileNotFoundError):
        load_dict(spark, str(tmp_path / "none"), "other")
    with pytest.raises(IsADirectoryError):
        load_dict(spark, str(tmp_path), "other")
    assert "other" not in D.registry(spark).frames
    assert {r.word for r in stored(from_words(spark, ["  ศาล "]), "reference").collect()} == {"  ศ"}
    with pytest.raises(ValueError):
        D.broadcast_words(D.registry(spark).words("filed"), limit=3)


def test_segment(spark):
    D.load_words(spark, MINI_TH, "th")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*GOLDEN, "", None])], "id int, t string")
    rows = df.select(segment("t", "th").alias("a"), segment("t", "th", parallel=True).alias("b")).collect()
    assert [r.a for r in rows] == [t.split("|") for t in GOLDEN.values()] + [[], []] and all(r.a == r.b for r in rows)
    again = df.repartition(3).select("id", segment("t", "th").alias("a")).orderBy("id").collect()
    assert [r.a for r in again] == [r.a for r in rows]
    with pytest.raises(RuntimeError, match="Dictionary name nope does not exist."):
        segment("t", "nope")
    offsets = token_offsets(df, "id", segment("t", "th")).where("id = 0").orderBy("pos").collect()
    assert [(r.token, r.start, r.end) for r in offsets] == [("ไข่", 0, 3), ("คน", 3, 5), ("2021", 5, 9)]


def test_batch_holds_few_tokens_as_python_strings(spark):
    """A batch of 300,000 tokens took over 10 MB as Python strings; the same tokens as text by text."""
    words = ["the", "der"]
    texts = ["the ab1,2 x-y\n" * 500, None, "", "der" * 700, *["a b" * 100_000] * 2, *["the "] * 3]
    tokens = _udf(SimpleNamespace(value=words), False).func
    assert tokens(pa.array(texts, pa.string())).to_pylist() == [segment_text(t, Words(words)) for t in texts]
    many = pa.array(["alpha beta " * 500] * 150)
    tracemalloc.start()
    got = tokens(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got.flatten()) == 300_000 and peak < 7e6, peak


def test_batch_in_parts_is_lossless(spark):
    """Parts of any size give the same tokens, which join back to the texts."""
    words, texts = Words(["the", "der"]), ["the ab1,2 x-y\n" * 5, None, "", "der" * 7, "ไข่คน2021"]
    for safe in (False, True):
        got = [_batch(pa.array(texts), words, safe, held=n).to_pylist() for n in (1, 5, 1000)]
        assert got[0] == got[1] == got[2] == [segment_text(t, words, safe) for t in texts]
        assert ["".join(t) for t in got[0]] == [t or "" for t in texts]


def test_tokens_leave_in_parts_of_a_batch(spark):
    """A worker held the tokens of a whole batch, 9 MB here; now those of a part, in segment and in the SQL functions."""
    words, texts = ["the", "der"], [*["alpha beta " * 500] * 300, None, "", "der" * 200_000, *["the ab1,2"] * 3, *[None] * 5]
    tokens = _udf_in_parts(SimpleNamespace(value=words), False).func
    sizes, got = [], []
    for part in tokens(iter([pa.array(texts[:150]), pa.array([], pa.string()), pa.array(texts[150:])])):
        sizes.append(part.nbytes)
        got += part.to_pylist()
    assert got == [segment_text(t, Words(words)) for t in texts]
    assert max(sizes) < 4e6 and len(sizes) > sum(len(t or "") for t in texts) // HELD_CHARS // 2, sizes
    D.load_words(spark, words, "in_parts")
    register_functions(spark, "in_parts")
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(2)
    in_one = df.select("i", segment("t", "in_parts", spark=spark).alias("a"), F.expr("thai_segment(t)").alias("b"), F.expr("thai_segment_safe(t)").alias("c"))
    plan = in_one._jdf.queryExecution().executedPlan().toString()
    kinds = re.findall(r"ArrowEvalPython .*, (\d+)$", plan, re.M)
    assert kinds and set(kinds) == {str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)}, plan
    for r in in_one.collect():
        assert r.a == (r.b or []) == segment_text(texts[r.i], Words(words)) and (r.c or []) == segment_text(texts[r.i], Words(words), True)


def test_plain_equals_core(spark):
    texts = ["a\r\nb\n\n\tc\rd", "x-y 1,234.50,", "ไข่คน2021", "๑๒,๓ ab\U0001f600c", "!!\r"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(segment_plain("t").alias("a")).collect()
    assert [r.a for r in got] == [segment_text(t, Words([])) for t in texts]


def test_plain_equals_core_on_random_text(spark):
    """Also where a cluster holds a space, and on very long runs."""
    rng = random.Random(13)
    parts = [*"กรขเแโาำะัิีุู็์่้ำ ๑12,.-ab\t\r\n!฿", "กรรข์ ็", "รร", "์ ็", "เก", "เริ", "  "]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000)] + ["ก" * 200_000, "เกีย" * 50_000, "กรรข์ ็x"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", segment_plain("t").alias("a")).collect()
    for r in got:
        assert r.a == segment_text(texts[r.i], Words([])), texts[r.i][:50]


def test_pieces_equal_core_on_random_text():
    """Texts side by side don't touch each other; also in batches that are cut anywhere."""
    rng = random.Random(3)
    parts = [*"ab-Z19,.  \t\r\n!\u00e9\U0001f600\x00\u4e2d", "\r\n", "1,2", "1.", ".5", "\r\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)] + [None, "1,", "2", ",3", "\r", "\n", ""]
    for array, held in ((pa.array(texts), 1 << 20), (pa.array(texts), 1), (pa.array(["x\r", *texts])[1:], 100)):
        got = pieces_of(array, held).to_pylist()
        for t, pieces in zip(texts, got, strict=True):
            want = segment_text(t, Words([]))
            assert pieces == [{"token": w, "end": e} for w, e in zip(want, accumulate(map(len, want)))], t
    assert pieces_of(pa.array([], pa.string())).to_pylist() == [] and pieces_of(pa.array([None], pa.string())).to_pylist() == [[]]


def test_plain_offsets(spark, monkeypatch):
    """Texts with and without Thai; those without need no pattern."""
    texts = ["a\u00e9 1,2\r\nb", "", None, "ไข่คน2021 ab", "๑๒,๓ x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = sorted(map(tuple, token_offsets(df, "i", segment_plain("t")).collect()))
    assert sorted(map(tuple, plain_offsets(df, "i", "t", segment_plain("t")).collect())) == want
    monkeypatch.setattr(C, "NO_DICTIONARY", "no such text")
    assert sorted(map(tuple, plain_offsets(df, "i", "t", segment_plain("t")).collect())) == [r for r in want if r[0] == 0]


def test_sql_functions(spark):
    D.load_words(spark, MINI_TH, "th_sql")
    register_functions(spark, "th_sql")
    assert spark.sql("SELECT thai_segment('ไข่คน2021')").first()[0] == ["ไข่", "คน", "2021"]
    rows = spark.sql("SELECT t.* FROM (SELECT 'ไข่คน2021' AS x), LATERAL thai_tokens(x) t ORDER BY pos").collect()
    assert [tuple(r) for r in rows] == [(0, "ไข่", 0, 3), (1, "คน", 3, 5), (2, "2021", 5, 9)]


def test_streams(spark, tmp_path):
    D.load_words(spark, MINI_TH, "th_stream")
    spark.createDataFrame([(1, "ไข่คน"), (2, "a b")], "id long, t string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in [("tokens", token_stream(stream, "id", "t", "th_stream"), "append"), ("counts", token_counts(stream, "ts", "t"), "complete")]:
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.id, r.token) for r in spark.sql("SELECT * FROM tokens").collect()} == {(1, "ไข่"), (1, "คน"), (2, "a"), (2, " "), (2, "b")}
    assert spark.sql("SELECT sum(count) FROM counts").first()[0] == 4
