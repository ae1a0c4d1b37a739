"""Suffix stripping of English words (M. F. Porter, 1980, with the author's later bli and logi rules).

Two forms of one rule table: a function of a word, for the distinct terms of an
index, and SQL over a table of terms.
"""

from __future__ import annotations

import re

# fixed values: suffixes, what replaces them, by step
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Shorter and longer words stay as they are.
LEAST, MOST = 3, 64


def shape(word: str) -> str:
    """c and v for each character: y is a vowel behind a consonant, what is no ASCII letter a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(form: str) -> int:
    return len(re.findall("v+c+", form))


def _short(word: str, form: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last not w, x or y."""
    return form.endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    if not LEAST <= len(word) <= MOST:
        return word
    end = _longest(word, ("sses", "ies", "ss", "s"))
    if end in ("sses", "ies"):
        word = word[:-2]
    elif end == "s":
        word = word[:-1]
    form = shape(word)
    end = _longest(word, ("eed", "ed", "ing"))
    if end == "eed":
        word = word[:-1] if measure(form[:-3]) > 0 else word
    elif end and "v" in form[: -len(end)]:
        word = word[: -len(end)]
        form = form[: len(word)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif form.endswith("cc") and word[-1] == word[-2] and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(form) == 1 and _short(word, form):
            word += "e"
    if word.endswith("y") and "v" in shape(word)[:-1]:
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        end = _longest(word, rules)
        if end and measure(shape(word)[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    end = _longest(word, STEP_4)
    if end:
        rest = word[: -len(end)]
        if measure(shape(rest)) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        m = measure(shape(rest))
        if m > 1 or (m == 1 and not _short(rest, shape(rest))):
            word = rest
    if word.endswith("ll") and measure(shape(word)) > 1:
        word = word[:-1]
    return word


def porter_sql(terms: str, name: str) -> str:
    """CTEs of DuckDB SQL that end in name(term, stem) over the table terms(term); later ones read columns t, w (so far) and c (its shape)."""
    form = "list_reduce(list_prepend('', string_split(w, '')), lambda a, ch: a || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') OR (ch = 'y' AND ends_with(a, 'c')) THEN 'v' ELSE 'c' END)"

    def m(cut: int | str) -> str:
        return f"len(regexp_extract_all(substr(c, 1, length(c) - {cut}), 'v+c+'))"

    def less(n: int, more: str = "") -> str:
        return f"substr(w, 1, length(w) - {n})" + (f" || '{more}'" if more else "")

    def ends(*suffixes: str) -> str:
        return "(" + " OR ".join(f"ends_with(w, '{s}')" for s in suffixes) + ")"

    def short(cut: int) -> str:
        return f"(ends_with(substr(c, 1, length(c) - {cut}), 'cvc') AND substr(w, length(w) - {cut}, 1) NOT IN ('w', 'x', 'y'))"

    def table(rules: dict[str, str], least: int) -> str:
        whens = "".join(f" WHEN ends_with(w, '{s}') THEN CASE WHEN {m(len(s))} > {least}{_ION if s == 'ion' else ''} THEN {less(len(s), r)} ELSE w END" for s, r in sorted(rules.items(), key=lambda x: -len(x[0])))
        return f"CASE{whens} ELSE w END"

    vowel = lambda n: f"contains(substr(c, 1, length(c) - {n}), 'v')"
    steps = [
        (f"CASE WHEN {ends('sses', 'ies')} THEN {less(2)} WHEN {ends('ss')} THEN w WHEN {ends('s')} THEN {less(1)} ELSE w END", "false"),
        (f"CASE WHEN {ends('eed')} THEN CASE WHEN {m(3)} > 0 THEN {less(1)} ELSE w END WHEN {ends('ed')} AND {vowel(2)} THEN {less(2)} WHEN {ends('ing')} AND {vowel(3)} THEN {less(3)} ELSE w END", f"NOT {ends('eed')} AND (({ends('ed')} AND {vowel(2)}) OR ({ends('ing')} AND {vowel(3)}))"),
        (f"CASE WHEN NOT cut THEN w WHEN {ends('at', 'bl', 'iz')} THEN w || 'e' WHEN ends_with(c, 'cc') AND substr(w, length(w), 1) = substr(w, length(w) - 1, 1) AND substr(w, length(w), 1) NOT IN ('l', 's', 'z') THEN {less(1)} WHEN {m(0)} = 1 AND {short(0)} THEN w || 'e' ELSE w END", "false"),
        (f"CASE WHEN {ends('y')} AND {vowel(1)} THEN {less(1, 'i')} ELSE w END", "false"),
        (table(STEP_2, 0), "false"),
        (table(STEP_3, 0), "false"),
        (table(dict.fromkeys(STEP_4, ""), 1), "false"),
        (f"CASE WHEN {ends('e')} AND ({m(1)} > 1 OR ({m(1)} = 1 AND NOT {short(1)})) THEN {less(1)} ELSE w END", "false"),
        (f"CASE WHEN {ends('ll')} AND {m(0)} > 1 THEN {less(1)} ELSE w END", "false"),
    ]
    out = [f"{name}0 AS (SELECT DISTINCT term AS t, term AS w, false AS cut FROM {terms} WHERE length(term) BETWEEN {LEAST} AND {MOST})"]
    for i, (word, cut) in enumerate(steps):
        out.append(f"{name}{i + 1} AS (SELECT t, {word} AS w, {cut} AS cut FROM (SELECT *, {form} AS c FROM {name}{i}))")
    out.append(f"{name} AS (SELECT t AS term, w AS stem FROM {name}{len(steps)} UNION ALL SELECT DISTINCT term, term FROM {terms} WHERE length(term) NOT BETWEEN {LEAST} AND {MOST})")
    return ",\n".join(out)


_ION = " AND substr(w, length(w) - 3, 1) IN ('s', 't')"
