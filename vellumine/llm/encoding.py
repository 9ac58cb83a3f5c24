"""Text decoded with the wrong character encoding: find it and turn it back.

Plan: segments are reduced to their ASCII skeleton (numbers and names masked),
garbled ones are joined with clean near-twins of the same skeleton, by what the
codec pairs make of the clean ones.  The ASCII characters of such a pair are its
anchors: they align the stretches between them, and the characters of every
aligned stretch vote for the (wrong, right) codec pairs that map all of them.  The votes are a table of some hundred rows,
the mappings learned, which alone are applied to every record in one narrow map.
What was lost (U+FFFD) comes back only from a twin that leaves no choice.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.runtime import broadcast_if_small, cut, spread

# Names of public codecs.
WRONG_SINGLE = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp1250", "cp1253", "cp850", "cp1254", "cp866", "koi8-r", "iso8859-2", "iso8859-7", "iso8859-15", "cp874", "cp1255", "cp1256", "cp1257", "mac_cyrillic", "cp852")
WRONG_DOUBLE = ("gbk", "cp932", "big5", "cp949")
RIGHT_LEGACY = ("cp1251", "koi8-r", "iso8859-7", "cp874", "cp1255", "cp1256", "euc_jp", "cp932", "gb18030", "big5", "cp949", "cp866", "iso8859-5")
SWAP_WRONG = ("cp1252", "cp1251", "mac_roman", "cp1250", "cp1253", "koi8-r", "cp437", "cp850")
SWAP_RIGHT = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-7", "cp874", "mac_roman", "cp437", "cp850", "cp1254", "cp1257", "cp1253")
SURE = [(w, "utf-8") for w in (*WRONG_SINGLE, *WRONG_DOUBLE)]
LEGACY = [("cp1252", r) for r in RIGHT_LEGACY]
SWAPS = [(w, r) for w in SWAP_WRONG for r in SWAP_RIGHT if w != r and (w, r) not in LEGACY]
ALL = SURE + LEGACY + SWAPS
#: The replacement character's own bytes, read once more as GBK.
LOST_TWICE = "锟斤拷"
LOST = re.compile("�|" + LOST_TWICE + "|ï¿½|[\x80-\x84\x86-\x9f]")
LOST_SQL = "\ufffd|" + LOST_TWICE + r"|ï¿½|[\x{80}-\x{84}\x{86}-\x{9f}]"

_LETTERS = [(0xA0, 0x17F), (0x218, 0x21B), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x60C, 0x6D3), (0x900, 0x97F), (0xE01, 0xE5B), (0x1E00, 0x1EFF), (0x2010, 0x2044), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x2500, 0x25FF), (0x2600, 0x27BF), (0x3000, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xFB01, 0xFB02), (0xFF00, 0xFFEF), (0xFFFD, 0xFFFD), (0x1F300, 0x1FAFF)]


def _common(c: str) -> bool:
    o = ord(c)
    return any(a <= o <= z for a, z in _LETTERS)


class _Codec:
    """The byte that each character of a single-byte codec stands for; undefined bytes stand for themselves."""

    def __init__(self, name: str):
        self.byte: dict[str, int] = {}
        for b in range(0x80, 0x100):
            try:
                c = bytes([b]).decode(name)
            except UnicodeDecodeError:
                c = chr(b)
            self.byte.setdefault(c, b)
        cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in self.byte.items() if lo <= b <= hi) + "]"
        tail = cls(0x80, 0xBF)
        self.leads = frozenset(c for c, b in self.byte.items() if 0xC2 <= b <= 0xF4)
        self.tails = frozenset(c for c, b in self.byte.items() if b <= 0xBF)
        self.seq = re.compile(f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}}")
        self.high = re.compile("[" + "".join(re.escape(c) for c in self.byte) + "]")


_codecs: dict[str, _Codec] = {}


def _codec(name: str) -> _Codec:
    if name not in _codecs:
        _codecs[name] = _Codec(name)
    return _codecs[name]


_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
_PAIR = re.compile("[^\\x00-\\x7f]{2}")
_TOKENS = re.compile(r"[^ \t\r\n]+")


def _from_utf8_single(token: str, wrong: str) -> str | None:
    """The token with UTF-8 byte sequences joined again, if they make up nearly all of its high characters."""
    c = _codec(wrong)
    covered, bad, deep = 0, False, False

    def back(m: re.Match) -> str:
        nonlocal covered, bad, deep
        try:
            ch = bytes(c.byte[x] for x in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        if "\x80" <= ch <= "\x9f" or ch in "ƒˆ˜":  # only where another layer lies below
            deep = True
        elif not _common(ch) or m.group().isalpha() and m.group().islower():
            bad = True
            return m.group()
        covered += len(m.group())
        return ch

    new = c.seq.sub(back, token)
    if bad or not covered or deep and not c.seq.search(new):
        return None
    rest = len(c.high.findall(token)) + token.count("�")
    return new if covered >= 0.75 * rest else None


def _from_utf8_double(token: str, wrong: str) -> str | None:
    """The same for codecs whose characters stand for two bytes; lost bytes stay lost."""
    if token.isascii():
        return None
    high = [c for c in token if not c.isascii() and c != "�"]
    if not high or 2 * sum("\u2e80" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" or "\uff61" <= c <= "\uff9f" for c in high) < len(high):
        return None
    raw = bytearray()
    for ch in token:
        if ch == "�":
            raw += b"\xff"
            continue
        try:
            raw += ch.encode(wrong)
        except UnicodeEncodeError:
            return None
    new = bytes(raw).decode("utf-8", "replace")
    good = [c for c in new if not c.isascii() and c != "�"]
    if not good or not all(_common(c) for c in good):
        return None
    size = sum(len(c.encode()) for c in good)
    total = sum(1 for b in raw if b >= 0x80) - raw.count(0xFF)
    if size < 0.7 * total:
        return None
    if len(good) <= 2 and all(ord(c) < 0x250 for c in good):  # a Latin letter inside a Latin word
        return new if re.search(r"[a-z][^\x00-\x7f]|[^\x00-\x7f][a-z]", token) and len(high) == len(good) else None
    return new if size >= 6 else None


_STRETCH = re.compile(r"[\xa1-\xff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€](?:[\xa0-\xff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€ .,;:!?%()\-\d«»\x80-\x9f]*[\xa0-\xff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€\x80-\x9f])?")
_SCRIPTS = {"cyr": (0x400, 0x45F), "gre": (0x370, 0x3FF), "tha": (0xE01, 0xE5B), "heb": (0x5D0, 0x5EA), "ara": (0x600, 0x6FF), "han": (0x3400, 0x9FFF), "kan": (0x3040, 0x30FF), "kor": (0xAC00, 0xD7A3)}


def _script(s: str) -> tuple[float, str]:
    """How much of the high characters are letters of one script family, and which."""
    n: Counter[str] = Counter()
    for c in s:
        for k, (a, z) in _SCRIPTS.items():
            if a <= ord(c) <= z:
                n[k] += 1
    total = sum(1 for c in s if not c.isascii() and (c.isalpha() or not 0x2010 <= ord(c) <= 0x206F) and not 0x3000 <= ord(c) <= 0x303F and not 0xFF00 <= ord(c) <= 0xFFEF)
    if not n or not total:
        return 0.0, ""
    if n["kan"] or n["han"]:
        return (n["kan"] + n["han"]) / total, "kan" if n["kan"] else "han"
    k, m = n.most_common(1)[0]
    return m / total, k


def _legacy(text: str, rights: list[str]) -> str:
    """Stretches written wholly in high Latin-1 characters, as the legacy codec that makes them words of one script."""
    c = _codec("cp1252")

    def back(m: re.Match) -> str:
        s = m.group()
        high = [x for x in s if not x.isascii()]
        letters = sum(1 for x in high if "À" <= x <= "ÿ")
        if len(high) < 6 or re.search(r"[A-Za-z]", s) or letters < 3:
            return s
        if any(b.isascii() and b.isalpha() for b in (text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1])) and len(high) < 12:
            return s
        raw = bytes(c.byte[x] if x in c.byte else (ord(x) if ord(x) < 0x100 else 0x3F) for x in s)
        best: tuple[float, str] = (0.0, s)
        for rank, r in enumerate(rights):
            try:
                t = raw.decode(r)
            except UnicodeDecodeError:
                continue
            share, script = _script(t)
            if share < 0.9:
                continue
            points = share - rank / 1000
            if script == "cyr":
                low = sum(1 for x in t if x.islower()) / max(1, sum(1 for x in t if x.isalpha()))
                points += low + sum(t.lower().count(x) for x in "оеаин") / max(1, len(t))
            elif script == "kan" and r in ("euc_jp", "cp932"):
                points += 1.5
            elif script in ("kan", "han", "kor"):  # stray kana speak for no other codec
                points += 0.5 - 0.5 * (sum(1 for x in t if not 0x4E00 <= ord(x) <= 0x9FA5 and not x.isascii()) / max(1, len(t)))
            elif script == "tha":
                points += 0.9
            elif script == "gre":
                points += sum(1 for x in t if x.islower()) / max(1, sum(1 for x in t if x.isalpha())) + sum(t.lower().count(x) for x in "αοιετσν") / max(1, len(t))
            if points > best[0]:
                best = (points, t)
        return best[1]

    return _STRETCH.sub(back, text)


_ODD = re.compile(
    r"[^\W\d_][¡-©«-´¸-¿‰ˆ˜™‹›‚„…†‡•√∞∂∑∏∫ﬁﬂ◊⁄˘˙˚˛¸˝ˇ÷×](?=[^\W\d_])"  # a sign inside a word
    r"|[^\W\d_][³¿¹¶¼¾](?=[^\W\d_])|\b[³¿¹][^\W\d_]|ﬂ|ﬁ|[‰¸∂][a-z]|[a-z](?<!\bm)(?<!\b[kcdm]m)[‰¸·¹³](?!\w)"
    r"|[a-z][À-ÖØ-ÞŒŠŽŸıˆ˜˙˚][a-z’]|[a-z][À-ÖØ-ÞŸŒ]\b|\b[A-Z][À-ÖØ-Þ][a-z]{2}|\b[À-ÖØ-Þ][a-z]*[À-ÖØ-Þ]\b"
    r"|[A-Za-z][Ѐ-ӿͰ-Ͽ]|[Ѐ-ӿͰ-Ͽ][A-Za-z]"  # two scripts in a word
    r"|[а-яё][А-ЯЁ]|[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЅѕІіј]|[Ѐ-ӿ][^\w\s.,;:!?…»«“”„()'’·—–-]+[Ѐ-ӿ]"
    r"|[À-ÿ]{4}|[\x80-\x9f]"
)


@cache
def _retold(w: str, r: str) -> dict[int, str]:
    """What the characters of single-byte codec ``w`` are under ``r``, where both know them; none for codecs of several bytes."""
    out = {ord("\u200b"): "\u200b", 0xFFFD: "\ufffd"}
    for c, b in _codec(w).byte.items():
        try:
            out[ord(c)] = bytes([b]).decode(r)
        except UnicodeDecodeError:
            continue
    return out


def _reread(line: str, w: str, r: str) -> str | None:
    """The line's bytes under codec ``w`` read as ``r``; None where that cannot be."""
    table = _retold(w, r)
    return line.translate(table) if all(x.isascii() or ord(x) in table for x in set(line)) else None


#: Places that tell readings without odd ones apart: Hebrew, Arabic or Thai or a number sign within a Latin word, Greek or Cyrillic letters before a digit.
_UNLIKELY = re.compile(r"[A-Za-z](?=[\u0590-\u06ff\u0e00-\u0e7f№])|[\u0590-\u06ff\u0e00-\u0e7f№](?=[A-Za-z])|[Ͱ-ӿ](?=\d)")


def _swap(line: str, pairs: list[tuple[str, str]]) -> str:
    """The line under the pair of single-byte codecs that leaves the fewest odd places, if it leaves hardly any."""
    if line.isascii():
        return line
    odd = len(_ODD.findall(line))
    if not odd:
        return line
    best, out = odd * 0.25, line
    high = sum(1 for c in line if not c.isascii())
    for rank, (w, r) in enumerate(pairs):
        t = _reread(line, w, r)
        if t is None:
            continue
        left = len(_ODD.findall(t)) + 0.3 * sum(1 for x in t if not x.isascii() and not (x.isalpha() or x in "«»“”„‘’…–—·°£€§№¿¡\xa0²³½" or x == "\ufffd"))
        left += 0.001 * rank + 0.05 * len(_UNLIKELY.findall(t)) + 0.05 * sum(1 for x in re.findall(r"\b[^\W\d_]*[^\x00-\x7f][^\W\d_]*", t) if not (x.islower() or x.istitle())) 
        if left < best and high:
            best, out = left, t
    return out


_ASCII = frozenset(map(chr, range(128)))
#: A stretch in a legacy codec has words of three such characters.
_THREE = re.compile(r"[\xa0-\xff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€\x80-\x9f]{3}")


@cache
def _plain(c: str) -> bool:
    """Whether a character makes no place odd, wherever it stands."""
    return not ("\u0370" <= c <= "\u04ff" or "\xc0" <= c <= "\xff" or _ODD.search(f"a{c}a {c}a a{c} {c} a{c}"))


class _Classes(dict):
    """What a character is to the rules of ``_ODD`` on Greek and Cyrillic: a letter of either, small or large, a Latin one, a rare one, a sign, or nothing."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        if c in "ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЅѕІіј":
            got = "r"
        elif "а" <= c <= "я" or c == "ё":
            got = "l"
        elif "А" <= c <= "Я" or c == "Ё":
            got = "u"
        elif "\u0400" <= c <= "\u04ff":
            got = "c"
        elif "\u0370" <= c <= "\u03ff":
            got = "g"
        elif c.isascii() and c.isalpha():
            got = "a"
        else:
            got = "s" if re.fullmatch(r"[^\w\s.,;:!?…»«“”„()'’·—–-]", c) else "o"
        self[o] = got
        return got


_CLASSES = _Classes()
_NEXT_TO = ("r", "lu", "al", "au", "ac", "ag", "la", "ua", "ca", "ga")
_SIGN_WITHIN = re.compile("[luc]s+[luc]")
_RUN = re.compile(r"[À-ÿ]{4}")
#: The rules of ``_ODD`` on Latin text with the odd character first, which the search can jump to.
_ODD_SIGN = re.compile(
    r"[¡-©«-´¸-¿‰ˆ˜™‹›‚„…†‡•√∞∂∑∏∫ﬁﬂ◊⁄˘˙˚˛¸˝ˇ÷×¶·À-ÖØ-ÞŒŠŽŸı](?:"
    r"(?<=[^\W\d_][¡-©«-´¸-¿‰ˆ˜™‹›‚„…†‡•√∞∂∑∏∫ﬁﬂ◊⁄˘˙˚˛¸˝ˇ÷×¶])(?=[^\W\d_])|(?<=\b[³¿¹])(?=[^\W\d_])|(?<=[ﬂﬁ])|(?<=[‰¸∂])(?=[a-z])"
    r"|(?<=[a-z][‰¸·¹³])(?<!\bm[‰¸·¹³])(?<!\b[kcdm]m[‰¸·¹³])(?!\w)|(?<=[a-z][À-ÖØ-ÞŒŠŽŸıˆ˜˙˚])(?=[a-z’])|(?<=[a-z][À-ÖØ-ÞŸŒ])\b"
    r"|(?<=\b[A-Z][À-ÖØ-Þ])(?=[a-z]{2})|(?<=\b[À-ÖØ-Þ])[a-z]*[À-ÖØ-Þ]\b)"
    r"|[À-ÿ]{4}|[\x80-\x9f]"
)


def _is_odd(text: str) -> bool:
    """Whether ``_ODD`` is found in the text, by the cheapest test that its characters allow."""
    own = [c for c in set(text) if not c.isascii() and not _plain(c)]
    latin = [c for c in own if not "\u0370" <= c <= "\u04ff"]
    if latin:
        small = all("ß" <= c <= "ÿ" and c != "÷" for c in latin)  # of these, only four in a row are odd
        if (_RUN if small else _ODD_SIGN).search(text):
            return True
    if len(latin) == len(own):
        return False
    kinds = text.translate(_CLASSES)
    return any(x in kinds for x in _NEXT_TO) or "s" in kinds and _SIGN_WITHIN.search(kinds) is not None


def repair(text: str, chains: list[tuple[str, str]]) -> tuple[str, bool]:
    """``(text, whether anything was turned back)``; several layers are undone one by one."""
    if text.isascii():
        return text, False
    single = [w for w, r in chains if r == "utf-8" and w in WRONG_SINGLE]
    double = [w for w, r in chains if r == "utf-8" and w in WRONG_DOUBLE]
    rights = [r for w, r in chains if (w, r) in LEGACY]
    swaps = [x for x in chains if x[1] != "utf-8"]
    changed = False
    while True:  # every layer undone leaves a shorter text
        own = set(text) - _ASCII
        votes: Counter[str] = Counter()
        memo: dict[tuple[str, str], str | None] = {}
        # A sequence has a lead and a tail, so most codecs are ruled out by the set of characters alone.
        likely = [w for w in single if not own.isdisjoint(_codec(w).leads) and not own.isdisjoint(_codec(w).tails) and _codec(w).seq.search(text)] if _PAIR.search(text) else []
        tokens = {t for t in _TOKENS.findall(text) if not t.isascii()} if likely else ()
        for t in tokens:
            for w in likely:
                memo[t, w] = new = _from_utf8_single(t, w)
                if new is not None:
                    votes[w] += len(t)
        done = text
        if votes:
            order = sorted(votes, key=lambda w: (-votes[w], single.index(w)))
            done = _TOKENS.sub(lambda m: next((memo[m.group(), w] for w in order if memo.get((m.group(), w)) is not None), m.group()), text)
        else:
            for w in double if _WIDE.search(text) else ():
                done = _TOKENS.sub(lambda m, w=w: m.group() if m.group().isascii() else _from_utf8_double(m.group(), w) or m.group(), text)
                if done != text:
                    break
        if len(done) >= len(text):
            break
        text, changed = done, True
    new = _legacy(text, rights) if rights and _THREE.search(text) else text
    if swaps and _is_odd(new):
        new = "\n".join(_swap(line, swaps) for line in new.split("\n"))
    return new, changed or new != text


SUSPECT = "[\\u0080-\\u0084\\u0086-\\u009f\\ufffd]|锟斤拷|[ÂÃÄÅĂĹ][\\u0080-\\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸˇ˘Łł¤Ąąşś]|â€|â‚|à[¤¥¸¹]|[ÐÑ][\\u0080-\\u00bf€-™]|[РСГВ][\\u00a0-\\u00bf‚ѓ„…†‡€‰Љ‹ЊЌЋЏђ‘’“”•–—™љ›њќћџЎўЈ¤Ґ¦§Ё©Є«¬Ї°±Ііґµ¶·ё№є»јЅѕї]|[├┬╨╤Γ][^\\s\\w]|√|¬|‚Ä|[\\u00c0-\\u00ff]{4}|[縺繧繝蜿縲]|[鈥銆鐨]|[a-z][\\u00b3\\u00bf\\u00b9\\u00c0-\\u00de\\u2030\\u0152\\u0160\\u02c6\\u02d9\\ufb02\\u00b8\\u0131]|[A-Za-z][\\u0370-\\u045f]|[\\u0430-\\u044f][\\u0410-\\u042f]|[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЅѕІіј]"


def _read_as(codec: str, leads: range) -> str:
    """The characters that two bytes of a double-byte codec stand for, the first of them one of ``leads``."""
    out = []
    for a in leads:
        for b in range(0x80, 0xC0):
            try:
                out.append(bytes([a, b]).decode(codec))
            except UnicodeDecodeError:
                continue
    return "".join(sorted({c for c in out if len(c) == 1}))


#: Han characters that the first two bytes of UTF-8 ones give when read as GBK; where they are many, they are suspect.
_HAN = _read_as("gbk", range(0xE4, 0xEA))


def _garbled_han(c: Column) -> Column:
    """Whether a sixth of the characters that are not ASCII, and two at least, are of ``_HAN``; by a lookup for each character."""
    n = F.length(c) - F.length(F.translate(c, _HAN, ""))
    return (n >= 2) & (6 * n >= F.length(F.regexp_replace(c, r"[\x00-\x7f]+", "")))


def _skeleton(c: Column) -> Column:
    c = F.regexp_replace(c, r"\d+", "0")
    return F.regexp_replace(c, r"[A-Z][a-z]+", "N")


def _aligned(garbled: str, clean: str) -> list[tuple[str, str]] | None:
    """The stretches of other characters between the same ASCII anchors, side by side; None where the anchors part differently."""
    g, c = _ANCHORS.split(garbled), _ANCHORS.split(clean)
    if len(g) != len(c) or any(a != b for a, b in zip(g[1::2], c[1::2])) or any(bool(a) != bool(b) for a, b in zip(g[::2], c[::2])):
        return None
    return [(a, b) for a, b in zip(g[::2], c[::2]) if a != b]


_ANCHORS = re.compile(r"([\x00-\x7f]+)")


@cache
def _table(name: str) -> str:
    """All 256 characters of a single-byte codec; undefined bytes stand for themselves."""
    back = {b: c for c, b in _codec(name).byte.items()}
    return "".join(map(chr, range(128))) + "".join(back.get(b, chr(b)) for b in range(128, 256))


@lru_cache(maxsize=1 << 16)
def _misread(clean: str, wrong: str, right: str) -> str | None:
    """What characters written in ``right`` look like when read as ``wrong``."""
    try:
        raw = clean.encode(right)
        return raw.decode(wrong, "replace") if wrong in WRONG_DOUBLE else codecs.charmap_decode(raw, "strict", _table(wrong))[0]
    except UnicodeError:
        return None


def mappings_of(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The (wrong, right) codec pairs that map every aligned stretch of the clean text to the garbled one's."""
    parts = _aligned(garbled, clean)
    if not parts:
        return []
    left = ALL
    for g, c in parts:
        left = [x for x in left if _misread(c, *x) == g]
        if not left:
            break
    return left


_WRONGS = {r: [w for w, r2 in ALL if r2 == r] for _, r in ALL}


def _misreads(clean: str) -> set[str]:
    """All that the pairs of ``ALL`` make of stretches, each on a line of its own; pairs that change nothing, or cannot write them all, give none."""
    out = set()
    for right, wrongs in _WRONGS.items():
        try:
            raw = clean.encode(right)
        except UnicodeError:
            continue
        for wrong in wrongs:
            if wrong in WRONG_DOUBLE:  # lost bytes at a stretch's end must not reach the next one
                out.add("\n".join(x.decode(wrong, "replace") for x in raw.split(b"\n")))
            else:
                out.add(codecs.charmap_decode(raw, "strict", _table(wrong))[0])
    return out - {clean}


def _garbled_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each clean segment, the stretches of every twin that a pair has garbled wholly."""
    for b in batches:
        out = [(i, m, x) for i, m, t in zip(b["id"], b["mark"], b["t"]) for x in _misreads(t)]
        yield pd.DataFrame(out, columns=["c", "mark", "t"])


def _garbled_beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each stretch that a garbled segment has as well, what it and a garbled neighbour would be there."""
    for b in batches:
        out = []
        for i, m, p, v, before, after in zip(b["id"], b["mark"], b["p"], b["v"], b["before"], b["after"]):
            out += [(i, m, p - 1, x, v) for x in (_misreads(before) if before else ())]
            out += [(i, m, p, v, x) for x in (_misreads(after) if after else ())]
        yield pd.DataFrame(out, columns=["c", "mark", "p", "v", "after"])


def _twins(s: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``(g, c)``: the garbled and clean segments of ``s (id, mark, seg, bad)`` that some pair of codecs maps, all of them, and few others.

    A pair of codecs changes all stretches of a twin, or it leaves some as they are. Then one of these stands beside
    a changed one. Both are looked up by equality, so that a skeleton with many segments costs no more than its rows.
    """
    s = s.withColumn("a", F.regexp_extract_all("seg", F.lit(r"([^\x00-\x7f]+)"), 1))
    bad = s.where("bad")
    good = s.where("not bad").join(broadcast_if_small(bad.select("mark").distinct(), max_rows), "mark", "left_semi")

    whole = lambda d: d.withColumn("t", F.array_join("a", "\n"))
    key = F.xxhash64("mark", "t").alias("key")
    forms = spread(whole(good).select("id", "mark", "t")).mapInPandas(_garbled_forms, "c long, mark long, t string").select("c", key)
    all_of_it = forms.join(broadcast_if_small(whole(bad).select(F.col("id").alias("g"), key), max_rows), "key")

    parts = lambda d: d.where(F.size("a") > 1).select("id", "mark", "a", F.posexplode("a").alias("p", "v")).select("id", "mark", "p", "v", F.get("a", F.col("p") - 1).alias("before"), F.get("a", F.col("p") + 1).alias("after"))
    at = F.xxhash64("mark", "p", "v").alias("key")
    kept = parts(good).withColumn("key", at).join(broadcast_if_small(parts(bad).select(at).distinct(), max_rows), "key", "left_semi").drop("key")
    two = F.xxhash64("mark", "p", "v", "after").alias("key")
    beside = kept.mapInPandas(_garbled_beside, "c long, mark long, p int, v string, after string").select("c", two)
    part_of_it = beside.join(broadcast_if_small(parts(bad).where("after is not null").select(F.col("id").alias("g"), two), max_rows), "key")

    ids = all_of_it.select("g", "c").unionByName(part_of_it.select("g", "c")).distinct()
    ids = ids.join(bad.select(F.col("id").alias("g"), F.col("seg").alias("garbled")), "g").join(good.select(F.col("id").alias("c"), F.col("seg").alias("clean")), "c")
    return ids.select(F.col("garbled").alias("g"), F.col("clean").alias("c"))


def learn_chains(texts: DataFrame, id_col: str = "id", text_col: str = "text", least_chars: int = 3) -> list[tuple[str, str]]:
    """The (wrong, right) codec pairs that turn clean segments into their garbled near-twins, best supported first.

    All distinct segments of all rows take part, each garbled one with every clean one that a pair maps to it. A pair
    is learned if the twins it explains show at least ``least_chars`` different characters. The result has at most
    ``len(ALL)`` pairs.
    """
    seg = F.explode(F.split(F.col(text_col), r"\n+|(?<=[.!?])\s+"))
    s = spread(texts.select(text_col).where(F.octet_length(text_col) > F.length(text_col))).select(seg.alias("raw")).where(F.col("raw").rlike(r"[^\x00-\x7f]"))
    s = s.select(_skeleton(F.col("raw")).alias("seg")).distinct()
    mark = F.xxhash64(F.regexp_replace("seg", r"[^\x00-\x7f]+", "\u0001"))  # the skeleton, and where other characters stand in it
    s = cut(s.select(F.xxhash64("seg").alias("id"), mark.alias("mark"), "seg", (F.col("seg").rlike(SUSPECT) | _garbled_han(F.col("seg"))).alias("bad")))  # both sides of the joins read it

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes: Counter[tuple[str, str, str]] = Counter()  # of a partition
        for b in batches:
            for g, c in zip(b["g"], b["c"]):
                for w_, r in mappings_of(g, c):
                    votes.update((w_, r, x) for x in set(c) if not x.isascii())
        yield pd.DataFrame([(*k, n) for k, n in votes.items()], columns=["w", "r", "c", "n"])

    votes = _twins(s).mapInPandas(vote, "w string, r string, c string, n long").groupBy("w", "r").agg(F.sum("n").alias("n"), F.countDistinct("c").alias("chars")).where(F.col("chars") >= least_chars)
    return [(v["w"], v["r"]) for v in sorted(votes.collect(), key=lambda v: (-v["n"], ALL.index((v["w"], v["r"]))))]


def repair_encoding(texts: DataFrame, id_col: str = "id", text_col: str = "text", chains: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(id, garbled boolean, lossy boolean, text)`` for every row: what was turned back stands in ``text``.

    ``chains`` are learned from twins where not given, and no others are applied (``ALL`` would be every pair known).
    ``lossy`` marks texts in which characters stay lost. Null texts stay null and are not garbled; empty texts and
    empty tables are fine; repeated rows are treated alike; other columns are not read.
    """
    use = learn_chains(texts, id_col, text_col) if chains is None else chains
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["i"], b["t"]):
                if t is None:
                    out.append((i, False, False, None))
                    continue
                new, changed = repair(t, use)
                lost = LOST.search(new) is not None
                out.append((i, changed or lost or LOST.search(t) is not None, lost, new))
            yield pd.DataFrame(out, columns=[id_col, "garbled", "lossy", "text"])

    return spread(texts.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))).mapInPandas(run, f"`{id_col}` {kind}, garbled boolean, lossy boolean, text string")


def garbled_ids(texts: DataFrame, id_col: str = "id", text_col: str = "text", chains: list[tuple[str, str]] | None = None) -> DataFrame:
    """The ids of the rows that :func:`repair_encoding` calls garbled; plain ASCII rows are dropped before the map."""
    some = texts.where(F.octet_length(text_col) > F.length(text_col))
    return repair_encoding(some, id_col, text_col, chains).where("garbled").select(id_col)


def restore_lost(texts: DataFrame, id_col: str = "id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """``(id, text)`` of rows with U+FFFD of which clean twins give a lost character without contradiction; what no twin gives stays lost.

    A twin has the same ASCII skeleton and the same number of characters between its anchors. Numbers and
    names may differ. Each garbled segment takes one row of candidates, aggregated before the join. Rows that share an id
    and a text give one row. With ``keys``, ``h`` is the hash of the text as it was.
    """
    some = texts.where(F.octet_length(text_col) > F.length(text_col)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    skel = F.regexp_replace("seg", r"[^\x00-\x7f]", "\u0001")
    clean = some.select(F.explode(F.split("t", r"(?<=\n)|(?<=[.!?] )")).alias("raw")).where(F.col("raw").rlike(r"[^\x00-\x7f]"))
    clean = clean.select(_skeleton(F.trim("raw")).alias("seg")).where(~F.col("seg").rlike(SUSPECT)).withColumn("skel", skel).groupBy("skel").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"))
    clean = clean.where(F.col("lo") == F.col("hi")).select("skel", F.regexp_extract_all("lo", F.lit(r"([^\x00-\x7f])"), 1).alias("chars"))
    hurt = some.where(F.col("t").contains("�")).distinct()
    seg = hurt.select("i", F.xxhash64("t").alias("h"), F.posexplode(F.split("t", r"(?<=\n)|(?<=[.!?] )")).alias("p", "raw"))
    mine = seg.withColumn("seg", _skeleton(F.trim("raw"))).withColumn("skel", skel).join(clean, "skel", "left")
    filled = F.expr("concat_ws('', zip_with(regexp_extract_all(raw, '([\\\\x00-\\\\x7f]*)([^\\\\x00-\\\\x7f])', 1), chars, (a, c) -> concat(a, c)), regexp_extract(raw, '([\\\\x00-\\\\x7f]*)$', 1))")
    # The characters that were not lost have to be the twin's own.
    agrees = F.expr("forall(zip_with(regexp_extract_all(raw, '([^\\\\x00-\\\\x7f])', 1), chars, (a, c) -> a = '�' or a = c), x -> x)")
    fixed = F.when(F.col("raw").contains("�") & F.col("chars").isNotNull() & agrees, filled).otherwise(F.col("raw"))
    done = F.col("raw") != F.col("f")
    out = mine.withColumn("f", fixed).groupBy("i", "h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "f"))), lambda x: x["f"]), "").alias("text"), F.max(done).alias("any"))
    return out.where("any").select(F.col("i").alias(id_col), "text", *(["h"] if keys else []))


def repair_and_restore(texts: DataFrame, id_col: str = "id", text_col: str = "text", chains: list[tuple[str, str]] | None = None) -> DataFrame:
    """:func:`repair_encoding` with lost characters filled in from twins among the repaired texts; ``lossy`` marks what is lost even then."""
    first = cut(repair_encoding(texts, id_col, text_col, chains))  # the twins, the hurt rows and the result are read from it
    back = restore_lost(first, id_col, "text", keys=True).select(F.col(id_col).alias("_i"), F.col("text").alias("_new"), F.col("h").alias("_h"))
    hurt = first.where(F.col("lossy") & F.col("text").contains("�"))
    rest = first.where(~(F.col("lossy") & F.coalesce(F.col("text").contains("�"), F.lit(False))))
    joined = hurt.join(back, hurt[id_col].eqNullSafe(F.col("_i")) & (F.xxhash64("text") == F.col("_h")), "left")
    new = F.coalesce("_new", "text")
    return rest.unionByName(joined.select(id_col, "garbled", new.rlike(LOST_SQL).alias("lossy"), new.alias("text")))
