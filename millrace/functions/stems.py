"""English stems by rules: the steps of the public Snowball algorithm for English, without its lists of exceptional words.

A step is a list of rules (ending, pattern, replacement); the first rule whose ending a word has is the one that counts, and
replaces its pattern if that fits (an ending may be too near the word's beginning). The same rules make Spark columns and SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let

#: A vowel and what is none. A y at a word's beginning or after a vowel is none and is written Y in between.
_V, _N = "[aeiouy]", "[^aeiouy]"
#: What must stand before an ending in the first and in the second region.
_R1 = f"{_N}*{_V}+{_N}.*"
_R2 = f"{_N}*{_V}+{_N}+{_V}+{_N}.*"
Rule = tuple[str, str, str]


def _in(region: str, endings: str, new: str = "") -> list[Rule]:
    """Rules that replace endings which have the region before them."""
    return [(f"{e}$", f"^({region}){e}$", rf"\1{new}") for e in endings.split()]


def _longest(rules: list[Rule]) -> list[Rule]:
    """Longer endings first, as they were listed within a length."""
    return sorted(rules, key=lambda r: -len(r[0]))


#: The steps of the algorithm.
STEPS: list[list[Rule]] = [
    [("^y", "^y", "Y")],
    [(f"{_V}y", f"({_V})y", r"\1Y")],
    [("sses$", "sses$", "ss"), ("..(?:ied|ies)$", "(?:ied|ies)$", "i"), ("(?:ied|ies)$", "(?:ied|ies)$", "ie"), ("(?:us|ss)$", "$", ""), ("s$", f"^(.*{_V}.+)s$", r"\1")],
    [("eed(?:ly)?$", f"^({_R1})eed(?:ly)?$", r"\1ee"), ("(?:ed|edly|ing|ingly)$", f"^(.*{_V}.*?)(?:ed|edly|ing|ingly)$", r"\1#")],
    [("(?:at|bl|iz)#$", "#$", "e"), ("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)#$", ".#$", ""), (f"^(?:{_N}+{_V}[^aeiouywxY]|{_V}{_N})#$", "#$", "e"), ("#$", "#$", "")],
    [("[yY]$", f"^(.+{_N})[yY]$", r"\1i")],
    _longest(
        _in(_R1, "tional", "tion") + _in(_R1, "enci", "ence") + _in(_R1, "anci", "ance") + _in(_R1, "abli", "able") + _in(_R1, "entli", "ent") + _in(_R1, "izer ization", "ize")
        + _in(_R1, "ational ation ator", "ate") + _in(_R1, "alism aliti alli", "al") + _in(_R1, "fulness fulli", "ful") + _in(_R1, "ousli ousness", "ous") + _in(_R1, "iveness iviti", "ive")
        + _in(_R1, "biliti bli", "ble") + _in(_R1, "lessli", "less")
    ) + [("logi$", f"^({_R1})ogi$", r"\1og"), ("[cdeghkmnrt]li$", f"^({_R1})li$", r"\1")],
    _longest(_in(_R1, "tional", "tion") + _in(_R1, "ational", "ate") + _in(_R1, "alize", "al") + _in(_R1, "icate iciti ical", "ic") + _in(_R1, "ful ness") + _in(_R2, "ative")),
    _longest(_in(_R2, "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize")) + [("[st]ion$", f"^({_R2})ion$", r"\1")],
    [("e$", f"^({_R2})e$", r"\1"), ("ll$", f"^({_R2}|{_R2.removesuffix('.*')}.*)l$", r"\1")],
    [(f"(?:^{_V}{_N}|{_N}{_V}[^aeiouywxY])e$", "$", ""), ("e$", f"^({_R1})e$", r"\1")],
    [("Y", "Y", "y")],
]


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Words of one or two letters, and null, are their own stems. Each step stands once in the
    expression (let), so it grows with the rules and not with their combinations; use it on distinct words."""
    def applied(step: list[Rule]):
        def one(w: Column) -> Column:
            cases = [(w.rlike(ending), F.regexp_replace(w, pattern, new.replace("\\1", "$1"))) for ending, pattern, new in step]
            some = w.rlike("|".join(f"(?:{ending})" for ending, _, _ in step))  # one test spares most words all the others
            return F.when(some, reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0]))).otherwise(w)

        return one

    stems = reduce(lambda w, step: let(w, applied(step)), STEPS, word)
    return F.when(F.char_length(word) <= 2, word).otherwise(stems)


def stem_sql(table: str, word: str = "term") -> str:
    """SQL that adds the column stem to a table of words: a subquery for each step."""
    sql = f"SELECT *, {word} AS stem FROM {table}"
    for step in STEPS:
        cases = " ".join(f"WHEN regexp_matches(stem, '{ending}') THEN regexp_replace(stem, '{pattern}', '{new}', 'g')" for ending, pattern, new in step)
        sql = f"SELECT * REPLACE (CASE {cases} ELSE stem END AS stem) FROM ({sql})"
    return f"SELECT * REPLACE (CASE WHEN length({word}) <= 2 THEN {word} ELSE stem END AS stem) FROM ({sql})"
