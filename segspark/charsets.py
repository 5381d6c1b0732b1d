"""Code points and patterns of the segmentation rules.

Everything here is a fixed value that has to equal the published rules for right results.
Thai marks are written as escapes, since combining marks are unreadable in editors.
"""

# Character sets.
CONSONANT = "[\u0e01-\u0e2e]"
TONE = "[\u0e48-\u0e4b]"
THAI = "\u0e00-\u0e7f"
KARAN = "\u0e4c"
ZERO_WIDTH_SPACE = "\u200b"

#: A run of one of these collapses to one.
COLLAPSING = "\u0e30-\u0e39\u0e42-\u0e44\u0e47-\u0e4d"

#: Code points stripped from both ends of dictionary words.
TRIMMED = "\u0009-\u000d\u0020\u0085\u00a0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"

#: Reorder rules (match, corrected groups, literal text of the reference mode), in order.
#: A replacement is a list of group numbers and text. Rules that never apply are left out.
REORDER = [
    ("\u0e40\u0e40", ["\u0e41"], ["\u0e41"]),
    ("\u0e4d\u0e32", ["\u0e33"], ["\u0e33"]),
    (f"\u0e4d({TONE})\u0e32", [1, "\u0e33"], ["\\1\u0e33"]),
    (f"({TONE})([\u0e31\u0e34-\u0e37])", [2, 1], ["\\2\\1"]),
    (f"({TONE})([\u0e38\u0e39])", [2, 1], ["\\2\\1"]),
    (f"\u0e33({TONE})", [1, "\u0e33"], ["\\1\u0e33"]),
    ("(\u0e4c)([\u0e31\u0e34-\u0e39])", [2, 1], ["\\2\\1"]),
]

# Abbreviations of the cluster rules: c a consonant, t an optional tone, k an optional silenced tail.
_SHORT = {"c": CONSONANT, "t": f"{TONE}?", "k": f"(?:{CONSONANT}{CONSONANT}?[\u0e34\u0e38\u0e39]?{KARAN})?"}
#: Cluster rules in order of preference. Rules that an earlier one always beats are left out.
CLUSTER_RULES = [
    "\u0e40c\u0e47ck",
    "\u0e40cct\u0e32\u0e30k",
    "\u0e40cc\u0e35t\u0e22\u0e30k",
    "\u0e40cc\u0e47ck",
    "\u0e40c\u0e34c\u0e4cck",
    "\u0e40c\u0e34tck",
    "\u0e40c\u0e35t\u0e22\u0e30?k",
    "\u0e40c\u0e37t\u0e2d\u0e30?k",
    "\u0e40ct\u0e32?\u0e30?k",
    "c\u0e31t\u0e27\u0e30k",
    "c[\u0e31\u0e37]tc[\u0e38\u0e34\u0e30]?k",
    "c[\u0e34\u0e38\u0e39]\u0e4ck",
    "c[\u0e30-\u0e39]tk",
    "c\u0e23\u0e23c\u0e4c \u0e47",
    "c\u0e47",
    "ct[\u0e30\u0e32\u0e33]?k",
    "\u0e41c\u0e47c",
    "\u0e41cc\u0e4c",
    "\u0e41ct\u0e30",
    "\u0e41cc\u0e47c",
    "\u0e41ccc\u0e4c",
    "\u0e42ct\u0e30",
    "[\u0e40-\u0e44]ct",
]
#: A cluster that fits one of these gives up its last character.
_SPLITS = ["\u0e40c\u0e34t\u0e22", "\u0e40c\u0e35t\u0e22"]


def expand(rule: str) -> str:
    return "".join(_SHORT.get(x, x) for x in rule)


_TAIL = f"{CONSONANT}{CONSONANT}?[\u0e34\u0e38\u0e39]?"
_AHEAD = {5: f"{expand(_SPLITS[0])}{_TAIL}(?={KARAN})", 6: f"{expand(_SPLITS[1])}{_TAIL}(?={KARAN})"}
_CLUSTERS = "|".join(p for i, r in enumerate(CLUSTER_RULES) for p in ([_AHEAD[i]] if i in _AHEAD else []) + [expand(r)])
#: A character that a cluster of several characters may start with.
CLUSTER_START = "[\u0e01-\u0e2e\u0e40-\u0e44]"
#: One pattern for all clusters; any other character is a cluster of its own, which most are told by at once.
CLUSTER = f"(?s)[^{CLUSTER_START[1:]}|{_CLUSTERS}|."
#: The same without look-ahead, for engines that have none; clusters that fit CLUSTER_SPLIT are cut before their last character.
CLUSTER_PLAIN = "(?s)" + "|".join(map(expand, CLUSTER_RULES)) + "|."
CLUSTER_SPLIT = "^(?:" + "|".join(f"{expand(s)}{_TAIL}{KARAN}" for s in _SPLITS) + ")$"

# Tokens that need no dictionary.
_DIGITS = "[0-9]+(?:[,.][0-9]+)*"
_THAI_DIGITS = "[\u0e50-\u0e59]+(?:[,.][\u0e50-\u0e59]+)*"
NON_THAI = ["[-a-zA-Z]+", _DIGITS, _THAI_DIGITS, "[ \t]+", "\r?\n"]
_OTHER = "[^-a-zA-Z0-9\u0e50-\u0e59 \t\r\n]"
#: A character that no cluster of several characters starts with.
_ALONE = "[^-a-zA-Z0-9\u0e50-\u0e59 \t\r\n\u0e01-\u0e2e\u0e40-\u0e44]"
#: Segmentation with an empty dictionary, for Java and Python: an unknown run goes on by whole clusters, one of which holds a space.
NO_DICTIONARY = "|".join([*NON_THAI, f"(?:{_ALONE}|{_CLUSTERS}|{_OTHER}|\r(?!\n))++"])
#: The same for engines without look-ahead (exact if no \r is followed by \n and no cluster holds a space).
NO_DICTIONARY_PLAIN = "|".join([*NON_THAI, f"(?:{_OTHER}|\r)+"])

# Limits.
EDGE_CAP = 50
WINDOW_MIN, WINDOW_MAX = 100, 140
