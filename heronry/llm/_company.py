"""How a company name is read: core words, kind of business, legal form; and how two words are compared."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Legal forms, filler words, values that name no company, and short forms (the nickname table).
LEGAL = frozenset("llc inc incorporated ltd limited gmbh ag ab aktiebolag bv nv sa sas srl spa pvt private pty plc corp corporation co company kg se oy llp lp".split())
FILLER = frozenset("the team division dept department careers jobs via recruiter agency hiring and und et y of at".split())
PLACEHOLDERS = frozenset("n/a|na|none|null|-|--|.|?|confidential|undisclosed|various|unknown|company|tbc|tbd|private|not disclosed|not specified|anonymous|client|our client|confidential company|hidden|test|recruiter|employer|see description|various companies".split("|"))
NICKNAMES = {
    "services": "svcs svc service serv servs",
    "logistics": "log logist logistic logs",
    "software": "softw sw soft",
    "manufacturing": "mfg manuf manufact manufg",
    "laboratories": "lab labs laboratory",
    "technologies": "tech technology techn techs technol",
    "systems": "sys system syst",
    "solutions": "solns soln solution sols sol",
    "consulting": "consult cons consultancy consultants",
    "engineering": "engrg eng engr engg engin",
    "international": "intl int inter internat",
    "health": "healthcare hlth",
    "energy": "energies enrg",
    "foods": "food fds",
    "partners": "partner ptnrs ptrs",
    "group": "grp groupe gruppe",
    "holdings": "holding hldgs",
    "industries": "industry inds",
}
KIND = {short: full for full, shorts in NICKNAMES.items() for short in (full, *shorts.split())}
#: Jaro-Winkler likeness from which two words can be the same word misspelt, and edits that two names may differ by in all their words together.
SAME, EDITS = 0.8, 2


@lru_cache(maxsize=200_000)
def jaro_winkler(a: str, b: str) -> float:
    """The published measure: Jaro, raised by 0.1 for each of up to four equal first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    t = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    lead = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return jaro + 0.1 * min(lead, 4) * (1 - jaro)


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Letters inserted, dropped, replaced or swapped with the next, each letter once; EDITS + 1 for more than EDITS."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > EDITS:
        return EDITS + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > EDITS:
            return EDITS + 1
        before, row = row, new
    return min(row[-1], EDITS + 1)


_SOUND = {c: str(k) for k, cs in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}


def sound(word: str) -> str:
    """Soundex: the first letter and three digits for the consonants after it."""
    out, last = word[:1].upper(), _SOUND.get(word[:1], "")
    for ch in word[1:]:
        d = _SOUND.get(ch, "")
        if d and d != last:
            out += d
        if ch not in "hw":
            last = d
    return (out + "000")[:4]


@lru_cache(maxsize=200_000)
def consonants(word: str, vowels: bool = False) -> str:
    """Soundex's digits of all consonants of a word, also of the first and of repeated ones, with the vowels between them or without: no edit of the word changes more than one sign."""
    return "".join(_SOUND.get(ch, ch if vowels or ch not in "aeiouhwy" else "") for ch in word)


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))


def head(word: str) -> str:
    """A word's first syllable: consonants, vowels, one consonant."""
    m = re.match(r"[^aeiou]*[aeiou]+[^aeiou]?", word)
    return m.group() if m else word


@lru_cache(maxsize=50_000)
def kind_of(word: str) -> str | None:
    if word in KIND:
        return KIND[word]
    if len(word) >= 5:  # a misspelt kind of business
        for full in NICKNAMES:
            if len(full) >= 5 and abs(len(full) - len(word)) <= 2 and word[0] == full[0] and jaro_winkler(word, full) >= 0.93:
                return full
    return None


def read(name: str | None) -> tuple[list[str], str] | None:
    """(core words sorted, kind of business or ''), or None where nothing names a company."""
    if name is None:
        return None
    s = re.sub(r"\s+", " ", plain(name)).strip()
    if s in PLACEHOLDERS or not s:
        return None
    s = s.replace("'", "").replace("\u2019", "")
    s = re.sub(r"\b(?:\w\.){2,}", lambda m: m.group().replace(".", "") + " ", s)
    words = [w for w in re.split(r"[^\w]+", s) if w]
    core, kind = [], ""
    for w in words:
        if w in LEGAL or w in FILLER:
            continue
        k = kind_of(w)
        if k:
            kind = kind or k
        else:
            core.append(w)
    if not core:
        return None
    return sorted(core), kind
