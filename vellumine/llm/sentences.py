"""Sentence units of documents in many scripts, in SQL expressions only.

Plan: three narrow ``Generate`` steps (document -> paragraph -> line-level
segment -> sentence) with JVM regular expressions between them; no shuffle, no
Python, no join.  Ambiguous marks are first replaced, character for character,
by private-use placeholders (decimals, URLs, initials, abbreviations, paired
quotation marks and brackets), the text is cut after the terminators of its
scripts, and the placeholders are turned back.  Because every mask keeps the
length, offsets are sums of piece lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP, DROP, HEAD = "\ue000", "\ue001", "\ue002"  # inserted; they count for nothing in lengths
DOT, CITE, QMARK = "\ue003", "\ue004", "\ue005"  # stand for . > ?
_PAIRS = [("„", "“"), ("„", "”"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ('"', '"'), ("‘", "’"), ("(", ")"), ("（", "）"), ("[", "]")]
_OPEN = [chr(0xE010 + i) for i in range(len(_PAIRS))]
_CLOSE = [chr(0xE020 + i) for i in range(len(_PAIRS))]
_INNER = [chr(0xE030 + i) for i in range(len(_PAIRS))]  # closing marks inside other pairs
_TERMS = ".!?…؟।॥۔։。！？｡;"
_HIDDEN = "".join(chr(0xE040 + i) for i in range(len(_TERMS)))  # terminators inside pairs
O, C, CO, CI = f"\ue010-{_OPEN[-1]}", f"\ue020-{_CLOSE[-1]}\ue030-{_INNER[-1]}", f"\ue020-{_CLOSE[-1]}", f"\ue030-{_INNER[-1]}"
WS = r"[\s\u00a0\u202f\u3000\ue004]"

# Abbreviations after which no sentence ends.
NEVER = (
    "Mr Mrs Ms Mx Dr Drs Prof Capt Col Gen Lt Sgt Rev Hon St Messrs Mme Mlle Mgr Me Sr Sra Srta Dra Herr Fr Hr Ing Dipl "
    "approx incl excl vs cf ca circa bzw usw evtl ggf inkl zzgl vgl resp env réf ref np tj tzn ok ul al pl im św prof "
    "ул пр просп им см ср напр тел гр тов κ κα κκ δηλ π.χ βλ αρ e.g i.e z.B d.h u.a o.ä डॉ श्री प्रो"
).split()
# Abbreviations after which no sentence ends if a number follows.
NUMERIC = (
    "No Nos Nr n p pp pg pág págs S s fig figs sec sect ext v vol ch art Art Abs par para pkt ust poz str стр п пп д г кв корп руб коп тыс млн ст гл рис σελ αριθ "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
).split()

# Months that are written with a capital after an ordinal number.
MONTHS = "Jänner Januar Jan Februar Feb März Mär April Apr Mai Juni Jun Juli Jul August Aug September Sept Sep Oktober Okt November Nov Dezember Dez".split()


def _any(words: list[str]) -> str:
    w = [*words, *(x[0].upper() + x[1:] for x in words if x[0].islower())]
    return "|".join(sorted({x.replace(".", r"[.\ue003]") for x in w}, key=lambda x: (-len(x), x)))


_B = r"(?<![\p{L}\p{M}\d])"
MASK_DOTS = (
    r"\.(?:(?<=\d\.)(?=\d)"  # decimals, dates, versions
    rf"|(?<={_B}(?:{_any(NEVER)})\.)"
    rf"|(?<={_B}(?:{_any(NUMERIC)})\.)(?={WS}*[\d§£€$])"
    rf"|(?<=(?<![\p{{L}}\p{{M}}\d'’])\p{{Lu}}\.)(?={WS}*\p{{Lu}}|{WS}+\d)"  # initials
    rf"|(?<=(?<![\p{{L}}\p{{M}}\d'’])\p{{L}}\.)(?={WS}*\p{{L}}[.\ue003])"  # abbreviations of several letters, each with its dot
    rf"|(?<=(?<!\d)\d{{1,2}}\.)(?={WS}*(?:{'|'.join(MONTHS)})(?!\p{{L}}))"  # ordinals in dates
    r"|(?<=(?<![\p{L}\p{M}])[ء-ي]\.)"  # one Arabic letter: a title
    r"|(?<=[\p{L}\d]\.)(?=[\p{Ll}/]))"  # inside addresses and file names
)
MASK_URL_Q = r"(?<=[\w/])\?(?=[\p{Ll}\d_]+=)"
_NEXT = rf"[{O}\p{{Ps}}\p{{Pi}}\"'¿¡*_~]*+{WS}*+(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}\d£€$§№]|\p{{Ll}}\p{{Lu}})"
_OUT = rf"(?![{C}])(?<![{CI}][\"”’»*_~]{{0,3}})"  # not before a closing mark, nor after one that leaves another pair open
_CJK = r"぀-ヿ㐀-鿿ｦ-ﾟ"
_AFTER = rf"[{C}\"”’»*_~]*+(?:(?={WS}+{_NEXT})"
_GLUED = rf"(?=[{O}¿¡]*+(?:\p{{Lu}}[\p{{Ll}}{WS[1:-1]}]|[ء-يऀ-ॣ]))"
#: Where other scripts or an ellipsis sign occur; elsewhere CUT_LATIN finds the same ends and starts from a cheaper class.
_WIDE = r"[\u0370-\u1fff\u2026\u3000-\udfff\uf900-\uffff]"
CUT_LATIN = rf"[.!?]++{_AFTER}|(?<=[!?][{C}]?)(?=[{O}¿¡\p{{Lu}}])|(?<=[\p{{Ll}}\d%€{C}]\.[{C}]?){_GLUED}){_OUT}"
CUT = (
    rf"[.!?…؟।॥۔։。！？｡]++{_AFTER}"
    rf"|(?<=[!?؟।॥۔][{C}]?)(?=[{O}¿¡\p{{Lu}}\p{{Lo}}])"
    rf"|(?<=[\p{{Ll}}\p{{Lo}}\p{{M}}\d%€{C}]\.[{C}]?){_GLUED}"
    rf"|(?<=[{_CJK}]\.)(?=[{_CJK}])"
    r"|(?<=[。！？｡])"
    rf"|(?<=[。！？｡][{C}]{{1,3}})(?={WS}|$)){_OUT}"
)
CUT_GREEK = rf";{_OUT}(?={WS}*+{_NEXT}|{WS}*+$)"
CUT_THAI = rf"(?:(?<=[฀-๿])|(?<=[฀-๿][{C}.!?])){WS}++(?!\d)|(?<![\d\s\u00a0\u202f\u3000]){WS}++(?=[{O}]?[฀-๿])"

_BLANK = r"\n[ \t\r\f\x0b\u00a0\u3000]*+(?=\n)"
_DELIM = r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*+\|?[ \t\r]*$|^[ \t]*(?:\*[ \t]*){3,}[ \t\r]*$|^[ \t]*={3,}[ \t\r]*$"
_ROW = r"(?m)^[ \t]*\|[^\n]*\|(?=[^|\n]*$)"
_HEADING = r"(?m)^([ \t]{0,3}#{1,6}(?=[ \t\r]|$))([^\n]*)$"
_BULLET = r"(?m)^([ \t\ue004]*(?:[-*+•‣◦]|\d{1,3}[.)])(?:[ \t]+\[[ xX]\](?=[ \t]))?)(?=[ \t]+\S)"
_BULLET_ONLY = r"(?m)^([ \t\ue004]*[-*+•‣◦](?:[ \t]+\[[ xX]\](?=[ \t]))?)(?=[ \t]+\S)"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


_RUN = 128


def _explode(df: DataFrame, keep: list[str], base: str, text: str) -> DataFrame:
    """``keep``, the piece as ``text`` and its offset as ``base``; inserted marks are not counted."""
    pieces = F.split(F.col(text), SEP)
    width = lambda s: F.length(s) - s.startswith(HEAD).cast("int") - s.endswith(DROP).cast("int")
    sums = lambda v: F.aggregate(v, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    df = df.select(*keep, F.col(base).alias("_b"), pieces.alias("_p"))
    # Running sums inside runs of pieces, then over the runs' totals: appending to one array would copy it for every piece.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_p") - 1) / _RUN).cast("int")), lambda i: sums(F.transform(F.slice(F.col("_p"), i * _RUN + 1, F.lit(_RUN)), width)))
    df = df.select(*keep, "_b", "_p", F.when(F.size("_p") > 1, runs).otherwise(F.array(F.array(F.lit(0)))).alias("_q"))
    firsts = sums(F.transform(F.col("_q"), lambda q: F.element_at(q, -1)))
    starts = F.when(F.size("_q") > 1, F.flatten(F.zip_with(F.col("_q"), F.slice(firsts, F.lit(1), F.size("_q")), lambda q, f: F.transform(F.slice(q, F.lit(1), F.size(q) - 1), lambda x: x + f)))).otherwise(F.get("_q", F.lit(0)))
    # The zip is no plain column, so that no filter on it is inferred and pushed through all the replacements.
    df = df.select(*keep, "_b", F.explode(F.arrays_zip(F.col("_p").alias("s"), starts.alias("o"))).alias("_x"))
    return df.select(*keep, (F.col("_b") + F.col("_x.o")).alias(base), F.col("_x.s").alias(text)).where(F.col(text) != "")


def _mask_pairs(df: DataFrame, keep: list[str], t: str) -> DataFrame:
    """Paired quotation marks and brackets as placeholders of the same length; a pass runs only where its opener occurs."""
    for (a, z), o, c in zip(_PAIRS, _OPEN, _CLOSE):
        if a == '"':
            p = r'(?<![\p{L}\d])"(?=\S)([^"]*+)(?<=\S)"'
        elif a == "‘":
            p = r"‘([^‘’]*+(?:’(?=\p{L})[^‘’]*+)*+)’"
        else:
            p = rf"\Q{a}\E([^\Q{a}{z}\E]*+)\Q{z}\E" if a != "[" else r"\[([^\[\]]*+)\]"
        df = df.select(*keep, F.when(F.col(t).contains(a), _sub(F.col(t), p, f"{o}$1{c}")).otherwise(F.col(t)).alias(t))
    # What stands before a closing mark is inside a pair: its terminators are hidden, save those right before that mark,
    # and the closing mark it begins with leaves a pair open.
    parts = F.split(F.col(t), rf"(?=[{O}{CO}])")
    tail = lambda p: F.regexp_extract(p, rf"[{_TERMS[:-1]}]+[\"”’»*_~]*$", 0)
    hide = lambda p: F.concat(
        F.translate(F.substring(p, 1, 1), "".join(_CLOSE) + _TERMS, "".join(_INNER) + _HIDDEN),
        F.translate(p.substr(F.lit(2), F.greatest(F.length(p) - F.length(tail(p)) - 1, F.lit(0))), _TERMS, _HIDDEN),
        F.when(F.length(tail(p)) < F.length(p), tail(p)).otherwise(F.expr("''")),
    )
    df = df.withColumn("_parts", F.when(F.col(t).rlike(rf"[{CO}]"), parts))
    inside = F.transform(F.col("_parts"), lambda p, i: F.when(F.get(F.col("_parts"), i + 1).rlike(rf"^[{CO}]"), hide(p)).otherwise(p))
    return df.select(*keep, F.when(F.col("_parts").isNotNull(), F.array_join(inside, "")).otherwise(F.col(t)).alias(t))


def _restore(t: Column) -> Column:
    opened, closed = "".join(a for a, _ in _PAIRS), "".join(z for _, z in _PAIRS)
    return F.translate(t, DOT + CITE + QMARK + "".join(_OPEN) + "".join(_CLOSE) + "".join(_INNER) + _HIDDEN, ".>?" + opened + closed + closed + _TERMS)


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``(id_col, start_char, end_char[, unit])``: one row per sentence unit, in code points from 0, end exclusive.

    A blank line ends a unit; headings, list items without closing mark and pipe-table rows are one
    unit each; marks that lead a line (``#``, ``-``, ``1.``, ``>``) and delimiter rows are in none.
    Only the two named columns are read, so other columns may have any name.

    Null or blank texts and empty tables give no rows; a null id is kept as null; repeated rows give
    their units once for each repeat.  Characters U+E000 to U+E04F of the input come out as U+FFFD
    in ``unit``; positions are not affected.
    """
    own = "".join(chr(0xE000 + i) for i in range(0x50))
    t = F.col(text_col)
    t = F.when(t.rlike(f"[{own[0]}-{own[-1]}]"), F.translate(t, own, "\ufffd" * len(own))).otherwise(t)
    out = df.where(F.trim(F.col(text_col)) != "").select(F.col(id_col).alias("_id"), F.lit(0).alias("_o"), t.alias("_t"))
    t = _sub(_sub(F.col("_t"), r"(?m)^([ \t]*)>", f"$1{CITE}"), rf"(?m)^([ \t]*{CITE}[ \t]*)>", f"$1{CITE}")
    t = F.when(F.col("_t").contains(">"), t).otherwise(F.col("_t"))
    out = _explode(out.select("_id", "_o", _sub(t, _BLANK, f"$0{SEP}").alias("_t")), ["_id"], "_o", "_t")
    t = F.col("_t")
    u = F.when(t.contains("--") | t.contains("*") | t.contains("==="), _sub(t, _DELIM, f"{SEP}$0{DROP}{SEP}")).otherwise(t)
    u = F.when(t.contains("|"), _sub(u, _ROW, f"{SEP}{HEAD}$0{SEP}")).otherwise(u)
    u = F.when(t.contains("#"), _sub(u, _HEADING, f"{SEP}$1{DROP}{SEP}{HEAD}$2{SEP}")).otherwise(u)
    out = out.select("_id", "_o", "_t", u.alias("_u"))
    lists = F.when(F.col("_t").rlike(r"^[\s]*(?:[-*+•‣◦]|\d{1,3}[.)])[ \t]"), _sub(F.col("_u"), _BULLET, f"{SEP}$1{DROP}{SEP}"))
    out = out.select("_id", "_o", lists.otherwise(_sub(F.col("_u"), _BULLET_ONLY, f"{SEP}$1{DROP}{SEP}")).alias("_t"))
    out = _explode(out, ["_id"], "_o", "_t").where(~F.col("_t").endswith(DROP) & F.col("_t").rlike(r"\S"))
    dots = _sub(F.col("_t"), MASK_DOTS, DOT)
    dots = F.when(F.col("_t").contains("="), _sub(dots, MASK_URL_Q, QMARK)).otherwise(dots)
    wide = (F.octet_length("_t") > F.length("_t")) & F.col("_t").rlike(_WIDE)
    out = out.select("_id", "_o", "_t", wide.alias("_w"), dots.alias("_m"))
    out = _mask_pairs(out, ["_id", "_o", "_t", "_w"], "_m")
    cut = _sub(F.col("_m"), CUT, f"$0{SEP}")
    cut = F.when(F.col("_m").rlike(r"[\u0370-\u03ff]"), _sub(cut, CUT_GREEK, f"$0{SEP}")).when(F.col("_m").rlike(r"[\u0e00-\u0e7f]"), _sub(cut, CUT_THAI, f"$0{SEP}")).otherwise(cut)
    cut = F.when(F.col("_w"), cut).otherwise(_sub(F.col("_m"), CUT_LATIN, f"$0{SEP}"))
    out = out.select("_id", "_o", F.when(F.col("_t").startswith(HEAD), F.col("_t")).otherwise(cut).alias("_t"))
    out = _explode(out, ["_id"], "_o", "_t")
    blank = F.lit(" \t\n\r\x0b\f\u0085\u00a0\u202f\u3000" + CITE)
    out = out.select("_id", "_o", F.when(F.col("_t").startswith(HEAD), F.expr("substring(_t, 2)")).otherwise(F.col("_t")).alias("_s")).where(F.col("_s").rlike(r"\S"))
    out = out.select("_id", "_o", "_s", F.ltrim(F.col("_s"), blank).alias("_l"))
    out = out.select("_id", (F.col("_o") + F.length("_s") - F.length("_l")).alias("_a"), F.rtrim(F.col("_l"), blank).alias("_r")).where(F.col("_r") != "")
    cols = [F.col("_id").alias(id_col), F.col("_a").cast("long").alias("start_char"), (F.col("_a") + F.length("_r")).cast("long").alias("end_char")]
    return out.select(*cols, *([_restore(F.col("_r")).alias("unit")] if with_text else []))
