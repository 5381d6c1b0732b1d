"""Registered queries and their SQL. Queries run over whole tables; Thai cases come from inline rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark import charsets as C
from segspark.functions import normalize as N
from segspark.functions.clusters import cluster_ends, clusters
from segspark.functions.plain import plain_offsets
from segspark.functions.segment import register_functions, segment, segment_plain, token_rows
from segspark.operators import dictionary as D
from segspark.operators.dictionary import load_dict
from segspark.plans import analytics as A
from segspark.sources.wordlist import from_words, read_lines, stored

# ---- inline rows

SAMPLES = [
    "เเปลก",
    "นํา",
    "นํ้า",
    "นํา้",
    "กำ่",
    "ก่ั",
    "กู่",
    "พันธ์ุ",
    "นะะะ",
    "ก่่่",
    "มากกก",
    "ปี2021",
    "ราคา 550.75 บาท",
    "a  b\t\t\tc\n\n\nd",
    "a ​ b",
    "พิสูจน์ได้ค่ะ",
    "เรือน้อยลอยอยู่",
    "เรียนต์",
    "xก์y",
    "",
    None,
]
WORDS = ["  ศาล ", "ศาล", "ศาลา", "กาแฟ ", "42", "", " ", "a b", "﻿the", "there", "reto", "The", "Is"]
EXTRA, GONE = [" of ", "the", "ลา"], ["ศาลา", " 42 ", "ลา"]
LATIN = ["ción", "sting", "and", "the", "der"]

MINI_TH = "ไข่ คน ราคา บาท เขา ชอบ มาก ไป โรงเรียน สวัสดี ชาว โลก ชาวโลก การ ทดสอบ การทดสอบ ด้าน หน้า ด้านหน้า ยาว ชิ ค่าจ้าง ที่ ได้รับ ต้อง ทำให้ แรงงาน สามารถ เลี้ยง เลี้ยงดู ตัวเอง และ ครอบครัว อย่าง สม สมศักดิ์ศรี ศักดิ์ศรี ความ เป็น มนุษย์".split()
GOLDEN = {
    "ไข่คน2021": "ไข่|คน|2021",
    "ค่าจ้างที่ได้รับต้องทำให้แรงงานสามารถเลี้ยงดูตัวเองและครอบครัวอย่างสมศักดิ์ศรีความเป็นมนุษย์": "ค่าจ้าง|ที่|ได้รับ|ต้อง|ทำให้|แรงงาน|สามารถ|เลี้ยงดู|ตัวเอง|และ|ครอบครัว|อย่าง|สมศักดิ์ศรี|ความ|เป็น|มนุษย์",
    "ราคา ฿550.75 บาท": "ราคา| |฿|550.75| |บาท",
    "เขาชอบ pizza มาก": "เขา|ชอบ| |pizza| |มาก",
    "เคาไปโรงเรียน": "เคา|ไป|โรงเรียน",
    "สวัสดีชาวโลกHello World 123 !@#$%^&*": "สวัสดี|ชาวโลก|Hello| |World| |123| |!@#$%^&*",
    "การทดสอบ": "การทดสอบ",
    "ชิ" * 100: "|".join(["ชิ"] * 100),
    "ด้านหน้า" * 20: "|".join(["ด้านหน้า"] * 20),
    "ด้านหน้า" * 20 + "ก" * 40: "|".join(["ด้านหน้า"] * 20 + ["ก" * 40]),
    "ยาว" * 50: "|".join(["ยาว"] * 50),
    " ": " ",
}


# Texts, dictionaries and the tokens that the rules give.
_A = "a " * 25
CASES = [
    (None, ["x"], []),
    ("", ["x"], []),
    (" ", ["x"], [" "]),
    ("ไข่คน2021", [], ["ไข่คน", "2021"]),
    ("a\r\nb\n\n\tc\rd", [], ["a", "\r\n", "b", "\n", "\n", "\t", "c", "\r", "d"]),
    ("x-y 1,234.50,", [], ["x-y", " ", "1,234.50", ","]),
    ("xก์y", [], ["x", "ก์", "y"]),
    ("กรรข์ ็x", [], ["กรรข์ ็", "x"]),
    ("theretofore", ["the", "there", "reto"], ["the", "reto", "fore"]),
    ("abcd", ["a", "ab", "abc", "bcd", "cd"], ["a", "bcd"]),
    ("ตากลม", ["ตา", "ตาก", "กลม", "ลม"], ["ตา", "กลม"]),
    ("4200", ["42"], ["42", "00"]),
    ("เขา ไป โรงเรียน", ["เขา", "เขา ไป", "โรงเรียน"], ["เขา ไป", " ", "โรงเรียน"]),
    ("ฮฮฮกกคน", ["กก", "คน"], ["ฮฮฮกกคน"]),
    ("ก" * 60, ["ก" * n for n in range(1, 21)], ["ก" * n for n in (1, 20, 1, 20, 18)]),
    (_A[:49] + "การทดสอบ", ["การ", "ทดสอบ", "การทดสอบ"], [*_A[:49], "การทดสอบ"]),
    (_A + "การทดสอบ", ["การ", "ทดสอบ", "การทดสอบ"], [*_A, "การ", "ทดสอบ"]),
]
#: Fixed value: a text of 158 characters that safe mode cuts into parts of 40 and 118, and its tokens.
_UNIT = ["ราคา", " ", "550", " ", "บาท", " ", "เขา", "ชอบ", " ", "pizza", " ", "มาก", " "]
SAFE_TEXT = "".join(_UNIT) * 5 + "การทดสอบ"
SAFE_PARTS = [[*_UNIT, "ราคา", " ", "550", " ", "บ"], ["าท", *_UNIT[5:], *_UNIT * 3, "การทดสอบ"]]
#: Fixed value: the reference mode takes the second part's tokens from the start of the text, at the same lengths.
_LENGTHS = [len(t) for t in SAFE_PARTS[1]]
SAFE_REFERENCE = SAFE_PARTS[0] + [SAFE_TEXT[sum(_LENGTHS[:i]) : sum(_LENGTHS[: i + 1])] for i in range(len(_LENGTHS))]
#: Lines of a file of words, one of which is not UTF-8, and the words that it holds.
FILE = "กา\r\n  กาแฟ \n\nx\ry\n".encode() + b"\xff\xfe\n42"
FILE_WORDS = ["กา", "กาแฟ", "x\ry", "42"]


def _read(spark: SparkSession, d: str, table: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select(*cols)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """All documents, and the inline samples under negative numbers."""
    inline = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(SAMPLES)], "text_id long, text string")
    return _read(spark, d, "documents", F.col("doc_id").alias("text_id"), "text").union(inline)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents", F.col("doc_id").alias("text_id"), "text", "lang", "source")


def _q(text: str | None) -> str:
    """A string as SQL."""
    if text is None:
        return "NULL"
    return "'" + text.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(str(x) if isinstance(x, int) else _q(x) for x in r) + ')' for r in rows)}) v({names})"


_TEXTS = f"(SELECT doc_id AS text_id, text FROM documents UNION ALL SELECT * FROM {_values([(-1 - i, t) for i, t in enumerate(SAMPLES)], 'text_id, text')})"

# ---- normalization


def _norm(step):
    return lambda s, d: _texts(s, d).select("text_id", step(F.col("text")).alias("text"))


def _re(c: str, match: str, to: str) -> str:
    return f"regexp_replace({c}, {_q(match)}, {_q(to)}, 'g')"


def _sql_collapse(c: str) -> str:
    for x in " \t\n":
        c = _re(c, f"{x}{{2,}}", x)
    return c


def _sql_reorder(c: str, compat: str = "corrected") -> str:
    for match, corrected, literal in C.REORDER:
        parts = corrected if compat == "corrected" else literal
        c = _re(c, match, "".join(f"\\{p}" if isinstance(p, int) else p.replace("\\", "\\\\") for p in parts))
    return c


def _sql_marks(c: str) -> str:
    spans = C.COLLAPSING.split("-")
    points = [chr(x) for a, b in zip([s[-1] for s in spans[:-1]], [s[0] for s in spans[1:]]) for x in range(ord(a), ord(b) + 1)]
    for x in points:
        c = _re(c, f"{x}{{2,}}", x)
    return c


_SQL_NUMBER = _re("text", "([0-9]+)", " \\1 ")
_SQL_ZERO = "replace({}, chr(8203), '')"


def _sql_norm(number: bool, compat: str = "corrected") -> str:
    return _sql_marks(_sql_reorder(_sql_collapse(_SQL_ZERO.format(_SQL_NUMBER if number else "text")), compat))


def _from_texts(expr: str) -> str:
    return f"SELECT text_id, {expr} AS text FROM {_TEXTS}"


# ---- dictionaries


def _stored(s):
    return stored(from_words(s, WORDS))


def _list(s, words):
    return s.createDataFrame([(w,) for w in words], "word string")


def _trim(c: str) -> str:
    return f"regexp_replace({c}, {_q(f'^[{C.TRIMMED}]+|[{C.TRIMMED}]+$')}, '', 'g')".replace(chr(0xFEFF), "\\x{FEFF}")


def _words_sql(words) -> str:
    return f"SELECT {_trim('word')} AS word FROM {_values([(w,) for w in words], 'word')}"


_STORED = f"(SELECT DISTINCT word FROM ({_words_sql(WORDS)}) WHERE word <> '')"


def dict_prefixes(s: SparkSession, d: str) -> DataFrame:
    return D.prefixes(_documents(s, d), _stored(s))


# ---- segmentation

_P0 = _q(C.NO_DICTIONARY_PLAIN)


def _dict(s: SparkSession, name: str, words) -> str:
    D.load_words(s, words, name)
    return name


def seg_dict_latin(s: SparkSession, d: str) -> DataFrame:
    return token_rows(_documents(s, d), "text_id", segment("text", _dict(s, "latin", LATIN), spark=s))


def seg_thai_golden(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame(list(enumerate(GOLDEN)), "text_id long, text string")
    return token_rows(rows, "text_id", segment("text", _dict(s, "mini_th", MINI_TH), spark=s))


def seg_safe(s: SparkSession, d: str) -> DataFrame:
    return token_rows(_documents(s, d), "text_id", segment("text", _dict(s, "empty", []), safe=True, spark=s))


def seg_lossless(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("text_id", F.concat_ws("", segment("text", _dict(s, "latin", LATIN), spark=s)).alias("text"))


def seg_cases(s: SparkSession, d: str) -> DataFrame:
    """Nulls, ties, dead ends, the edge cap and its counter, short words: each text with its own dictionary."""
    out = None
    for words in dict.fromkeys(tuple(w) for _, w, _ in CASES):
        rows = s.createDataFrame([(i, t) for i, (t, w, _) in enumerate(CASES) if tuple(w) == words], "text_id long, text string")
        tokens = segment("text", _dict(s, f"case_{len(words)}_{'_'.join(words)[:20]}", words), parallel=True, spark=s)
        found = rows.select("text_id", tokens.alias("t")).select("text_id", F.size("t").alias("n_tokens"), F.concat_ws("|", "t").alias("tokens"))
        out = out.union(found) if out else found
    return out


def seg_safe_thai(s: SparkSession, d: str) -> DataFrame:
    """Safe mode with a dictionary, corrected and as the reference slices it."""
    rows = s.createDataFrame([(SAFE_TEXT,)], "text string")
    name = _dict(s, "mini_th", MINI_TH)
    modes = F.array(*(F.struct(F.lit(c).alias("compat"), segment("text", name, safe=True, compat=c, spark=s).alias("t")) for c in ("corrected", "reference")))
    return rows.select(F.explode(modes).alias("m")).select("m.compat", F.posexplode("m.t").alias("pos", "token"))


def seg_offsets(s: SparkSession, d: str) -> DataFrame:
    return plain_offsets(_documents(s, d), "text_id", "text", segment_plain("text"))


def seg_sql(s: SparkSession, d: str) -> DataFrame:
    """The SQL functions and the table function."""
    register_functions(s, _dict(s, "mini_th", MINI_TH))
    s.createDataFrame(list(enumerate(GOLDEN)), "text_id long, text string").createOrReplaceTempView("golden_texts")
    return s.sql("SELECT g.text_id, t.pos, t.token, t.start, t.`end`, size(thai_segment(g.text)) AS n_tokens FROM golden_texts g, LATERAL thai_tokens(g.text) t")


def _word_file(s: SparkSession) -> str:
    """The fixed lines as a file where all executors can read it."""
    where = (s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    jvm = s.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{where}/words-{uuid.uuid4().hex}.txt")
    fs = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(FILE)
    out.close()
    return fs.makeQualified(path).toString()


def dict_file(s: SparkSession, d: str) -> DataFrame:
    """The words that a file gives, bad lines left out."""
    return stored(read_lines(s, _word_file(s)))


def dict_load_twice(s: SparkSession, d: str) -> DataFrame:
    """A name is taken once: the second file is refused and the first one's words stay."""
    name, path = f"file_{uuid.uuid4().hex}", _word_file(s)
    results = [load_dict(s, path, name) for _ in range(2)]
    rows = s.createDataFrame([(i, m.split(":")[0], ok) for i, (m, ok) in enumerate(results)], "attempt long, message string, ok boolean")
    return rows.crossJoin(D.size(D.registry(s).words(name)))


_SAFE = f"""WITH RECURSIVE cuts AS (
  SELECT doc_id, 0 AS beg, 0 AS n, length(text) AS size, text FROM documents
  UNION ALL
  SELECT doc_id, beg + n, CASE WHEN size - beg - n < {C.WINDOW_MAX} THEN size - beg - n
      WHEN contains(substring(text, beg + n + 1 + {C.WINDOW_MIN}, 40), ' ') THEN 41 - strpos(reverse(substring(text, beg + n + 1 + {C.WINDOW_MIN}, 40)), ' ')
      ELSE {C.WINDOW_MIN} + list_sum(list_transform(list_slice(regexp_extract_all(substring(text, beg + n + 1 + {C.WINDOW_MIN}, 40), {_P0}), 1,
          len(regexp_extract_all(substring(text, beg + n + 1 + {C.WINDOW_MIN}, 40), {_P0})) - list_position(list_reverse(list_transform(regexp_extract_all(substring(text, beg + n + 1 + {C.WINDOW_MIN}, 40), {_P0}), lambda t: length(t))), list_max(list_transform(regexp_extract_all(substring(text, beg + n + 1 + {C.WINDOW_MIN}, 40), {_P0}), lambda t: length(t))))::INT), lambda t: length(t)))::INT END, size, text
  FROM cuts WHERE beg + n < size),
parts AS (SELECT doc_id, beg, regexp_extract_all(substring(text, beg + 1, n), {_P0}) AS t FROM cuts WHERE n > 0),
whole AS (SELECT doc_id AS text_id, flatten(list(t ORDER BY beg)) AS t FROM parts GROUP BY doc_id)
SELECT text_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS token FROM whole"""


def _tokens_sql(pattern: str = C.NO_DICTIONARY_PLAIN) -> str:
    return f"SELECT doc_id AS text_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, {_q(pattern)}) AS t FROM documents)"


_CLUSTERS = f"""SELECT text_id, flatten(list_transform(regexp_extract_all(text, {_q(C.CLUSTER_PLAIN)}),
  lambda x: CASE WHEN regexp_matches(x, {_q(C.CLUSTER_SPLIT)}) THEN [x[:-2], x[-1:]] ELSE [x] END)) AS t FROM {_TEXTS}"""
_WORDS_BY = f"SELECT lang, source, unnest(regexp_extract_all(text, {_P0})) AS token FROM documents"
_IS_WORD = "regexp_full_match(token, '[-a-zA-Z]+')"


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Tokens by language of the normalized documents."""
    return A.count_by(_documents(s, d), "lang", segment_plain(N.normalize("text")))


QUERIES = {
    "norm_full": _norm(N.normalize),
    "norm_no_number": _norm(lambda c: N.normalize(c, whitespace_number=False)),
    "norm_compat": _norm(lambda c: N.normalize(c, compat="reference")),
    "norm_number_space": _norm(N.number_space),
    "norm_zero_width": _norm(N.zero_width),
    "norm_collapse_ws": _norm(N.collapse_whitespace),
    "norm_reorder": _norm(N.reorder),
    "norm_collapse_marks": _norm(N.collapse_marks),
    "dict_words": lambda s, d: _stored(s),
    "dict_add": lambda s, d: D.add(_stored(s), _list(s, EXTRA)),
    "dict_remove": lambda s, d: D.remove(_stored(s), _list(s, GONE)),
    "dict_contains": lambda s, d: D.contains(_stored(s), _read(s, d, "documents", "doc_id", F.explode(F.split("text", " ")).alias("word"))).groupBy("word", "found").agg(F.count("*").alias("n")),
    "dict_size": lambda s, d: D.size(_stored(s)),
    "dict_prefixes": dict_prefixes,
    "tcc_clusters": lambda s, d: _texts(s, d).select("text_id", F.posexplode(clusters("text")).alias("pos", "cluster")),
    "tcc_ends": lambda s, d: _texts(s, d).select("text_id", F.explode(cluster_ends("text")).alias("end")),
    "seg_nodict": lambda s, d: token_rows(_documents(s, d), "text_id", segment_plain("text")),
    "seg_dict_latin": seg_dict_latin,
    "seg_thai_golden": seg_thai_golden,
    "seg_safe": seg_safe,
    "seg_lossless": seg_lossless,
    "seg_cases": seg_cases,
    "seg_safe_thai": seg_safe_thai,
    "seg_offsets": seg_offsets,
    "seg_sql": seg_sql,
    "dict_file": dict_file,
    "dict_load_twice": dict_load_twice,
    "tok_count_by_lang": flagship,
    "tok_topk": lambda s, d: A.top_tokens(_documents(s, d), segment_plain("text"), 50),
    "vocab_by_source": lambda s, d: A.vocabulary(_documents(s, d), "source", segment_plain("text")),
    "oov_rate": lambda s, d: A.unknown_rate(_documents(s, d), "lang", segment_plain("text"), _stored(s)),
}

SQL = {
    "norm_full": _from_texts(_sql_norm(True)),
    "norm_no_number": _from_texts(_sql_norm(False)),
    "norm_compat": _from_texts(_sql_norm(True, "reference")),
    "norm_number_space": _from_texts(_SQL_NUMBER),
    "norm_zero_width": _from_texts(_SQL_ZERO.format("text")),
    "norm_collapse_ws": _from_texts(_sql_collapse("text")),
    "norm_reorder": _from_texts(_sql_reorder("text")),
    "norm_collapse_marks": _from_texts(_sql_marks("text")),
    "dict_words": f"SELECT word FROM {_STORED}",
    "dict_add": f"SELECT word FROM {_STORED} UNION ({_words_sql(EXTRA)})",
    "dict_remove": f"SELECT word FROM {_STORED} WHERE word NOT IN ({_words_sql(GONE)})",
    "dict_contains": f"SELECT word, word IN (SELECT word FROM {_STORED}) AS found, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL",
    "dict_size": f"SELECT count(*) AS size FROM {_STORED}",
    "dict_prefixes": f'SELECT doc_id AS text_id, word, length(word)::INT AS "end" FROM documents JOIN {_STORED} w ON starts_with(text, word)',
    "tcc_clusters": f"SELECT text_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS cluster FROM ({_CLUSTERS})",
    "tcc_ends": f'SELECT text_id, (sum(length(cluster)) OVER (PARTITION BY text_id ORDER BY pos))::INT AS "end" FROM (SELECT text_id, unnest(range(len(t))) AS pos, unnest(t) AS cluster FROM ({_CLUSTERS}))',
    "seg_nodict": _tokens_sql(),
    "seg_dict_latin": _tokens_sql("|".join([*LATIN, C.NO_DICTIONARY_PLAIN])),
    "seg_thai_golden": "SELECT text_id::BIGINT AS text_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS token FROM (SELECT text_id, string_split(tokens, '|') AS t FROM " + _values([(i, t) for i, t in enumerate(GOLDEN.values())], "text_id, tokens") + ")",
    "seg_safe": _SAFE,
    "seg_lossless": "SELECT doc_id AS text_id, text FROM documents",
    "seg_cases": "SELECT text_id::BIGINT AS text_id, n_tokens, tokens FROM " + _values([(i, len(t), "|".join(t)) for i, (_, _, t) in enumerate(CASES)], "text_id, n_tokens, tokens"),
    "seg_safe_thai": "SELECT compat, pos, token FROM " + _values([(c, i, t) for c, tokens in (("corrected", sum(SAFE_PARTS, [])), ("reference", SAFE_REFERENCE)) for i, t in enumerate(tokens)], "compat, pos, token"),
    "seg_offsets": f'SELECT text_id, pos, token, ("end" - length(token))::INT AS start, "end"::INT AS "end" FROM (SELECT *, sum(length(token)) OVER (PARTITION BY text_id ORDER BY pos) AS "end" FROM ({_tokens_sql()}))',
    "seg_sql": 'SELECT text_id, pos, token, ("end" - length(token))::INT AS start, "end"::INT AS "end", n_tokens FROM (SELECT *, sum(length(token)) OVER (PARTITION BY text_id ORDER BY pos) AS "end", count(*) OVER (PARTITION BY text_id)::INT AS n_tokens FROM (SELECT text_id::BIGINT AS text_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS token FROM (SELECT text_id, string_split(tokens, \'|\') AS t FROM ' + _values([(i, t) for i, t in enumerate(GOLDEN.values())], "text_id, tokens") + ")))",
    "dict_file": "SELECT word FROM " + _values([(w,) for w in FILE_WORDS], "word"),
    "dict_load_twice": f"SELECT attempt::BIGINT AS attempt, message, ok = 1 AS ok, {len(FILE_WORDS)}::BIGINT AS size FROM " + _values([(0, "Successful", 1), (1, "Failed", 0)], "attempt, message, ok"),
    "tok_count_by_lang": f"SELECT lang, sum(len(regexp_extract_all({_sql_norm(True)}, {_P0})))::BIGINT AS n_tokens, count(*) AS n_texts FROM documents GROUP BY lang",
    "tok_topk": f"SELECT token, count(*) AS n FROM ({_WORDS_BY}) WHERE {_IS_WORD} GROUP BY token ORDER BY n DESC, token LIMIT 50",
    "vocab_by_source": f"SELECT source, count(DISTINCT token) AS n_words FROM ({_WORDS_BY}) WHERE {_IS_WORD} GROUP BY source",
    "oov_rate": f"SELECT lang, count(*) AS n_words, (count(*) FILTER (token NOT IN (SELECT word FROM {_STORED})))::BIGINT AS n_unknown FROM ({_WORDS_BY}) WHERE {_IS_WORD} GROUP BY lang",
}
