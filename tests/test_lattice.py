"""Golden rows and properties of the segmentation core."""

import random
from itertools import accumulate

import pytest

from segspark import charsets as C
from segspark.operators.lattice import Words, cut, ends_of_clusters, parts_of, segment_text
from segspark.queries import GOLDEN, MINI_TH

TH = Words(MINI_TH)
SPACED = ("a " * 30)[:50]
CASES = [
    ("", [], []),
    (" ", MINI_TH, [" "]),
    ("ไข่คน2021", [], ["ไข่คน", "2021"]),
    ("a\r\nb\n\n\tc\rd", [], ["a", "\r\n", "b", "\n", "\n", "\t", "c", "\r", "d"]),
    ("x-y 1,234.50,", [], ["x-y", " ", "1,234.50", ","]),
    ("theretofore", ["the", "there", "reto"], ["the", "reto", "fore"]),
    ("abcd", ["a", "ab", "abc", "bcd", "cd"], ["a", "bcd"]),
    ("ตากลม", ["ตา", "ตาก", "กลม", "ลม"], ["ตา", "กลม"]),
    ("4200", ["42"], ["42", "00"]),
    ("เขา ไป โรงเรียน", ["เขา", "เขา ไป", "โรงเรียน"], ["เขา ไป", " ", "โรงเรียน"]),
    ("ฮฮฮกกคน", ["กก", "คน"], ["ฮฮฮกกคน"]),
    ("xก์y", [], ["x", "ก์", "y"]),
    (SPACED[:49] + "การทดสอบ", ["การ", "ทดสอบ", "การทดสอบ"], [*SPACED[:49], "การทดสอบ"]),
    (SPACED[:50] + "การทดสอบ", ["การ", "ทดสอบ", "การทดสอบ"], [*SPACED[:50], "การ", "ทดสอบ"]),
]


@pytest.mark.parametrize("text, words, tokens", CASES)
def test_golden(text, words, tokens):
    assert segment_text(text, Words(words)) == tokens


def test_golden_thai():
    for text, tokens in GOLDEN.items():
        assert segment_text(text, TH) == tokens.split("|")


def test_cap():
    assert [len(t) for t in cut("ก" * 60, Words("ก" * n for n in range(1, 21)))] == [1, 20, 1, 20, 18]


def test_cluster_ends():
    assert sorted(ends_of_clusters("พิสูจน์ได้ค่ะ")) == [2, 7, 10, 13]
    assert sorted(ends_of_clusters("เรือน้อยลอยอยู่")) == [4, 6, 7, 8, 9, 10, 11, 12, 15]
    assert sorted(ends_of_clusters("เรียนต์")) == [6, 7]


def test_safe_mode():
    text = "ราคา 550 บาท เขาชอบ pizza มาก " * 5 + "การทดสอบ"
    assert [len(p) for p in parts_of(text, TH)] == [40, 118]
    tokens = segment_text(text, TH, safe=True)
    assert "".join(tokens) == text and tokens[-1] == "การทดสอบ"
    old = segment_text(text, TH, safe=True, compat="reference")
    assert [len(t) for t in old] == [len(t) for t in tokens] and len(old) == 67 and "".join(old) != text


def test_lossless_and_shortest_paths():
    """Against a brute force that tries every path, on texts below the cap."""
    rng = random.Random(1)

    def paths(text, at, words):
        if at == len(text):
            return [[]]
        return [[e, *rest] for n in range(1, len(text) - at + 1) if text[at : at + n] in words for e in [at + n] for rest in paths(text, e, words)]

    for _ in range(400):
        words = {"".join(rng.choice("abก") for _ in range(rng.randint(1, 4))) for _ in range(5)}
        text = "".join(rng.choice("abก") for _ in range(rng.randint(1, 9)))
        got = cut(text, Words(words))
        assert "".join(got) == text and all(got)
        if (all_paths := paths(text, 0, words)) and all(t in words for t in got):
            ends = list(accumulate(map(len, got)))
            assert ends in all_paths
    assert C.EDGE_CAP == 50
