"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score. SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.llm.spark import temporary

_LOCAL = "A-Za-z0-9._%+-"
_BLOCK = 128


#: Lengths of account numbers by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
_DOUBT = r"(?i)\b(?:order|tracking|serial|part|invoice|ticket|version|sample|example|dummy|muster|ejemplo|exemple)\b"


@dataclass(frozen=True)
class Kind:
    """``pattern`` is written so that a scan is linear: runs are possessive, and a match starts where its run starts.

    ``score`` is what a confirmed span has without context; a context word within ``reach`` code
    points adds ``bonus``, a word that speaks of other numbers takes ``malus`` off. Spans of
    ``base`` kinds count whatever their score, which goes with them.
    """

    name: str
    pattern: str
    needs: str
    context: str
    score: float
    bonus: float
    base: bool = True
    malus: float = 0.25


KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"(?i)e-?mail|contact|write|kontakt|correo|courriel", 0.8, 0.15),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"(?i)\bip\b|host|server|address|login|adresse", 0.5, 0.3),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "", r"(?i)card|visa|master|credit|payment|karte|carte|tarjeta", 0.7, 0.25),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", r"(?i)phone|call|tel|mobile|fax|anruf|llam", 0.6, 0.3),
    Kind("iban", _IBAN, "", r"(?i)iban|account|konto|compte|cuenta|bank", 0.7, 0.25, False),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", r"(?i)\bssn\b|social security|national id|identity|passport", 0.2, 0.5, False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _digits(m: Column) -> Column:
    return F.translate(m, "+ ().-", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total, i):
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = x * 2 - F.when(x > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number, without blanks, leaves 1 under ISO 7064 mod 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def add(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    """The checksum or range rule of a kind."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        code = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & mod97(code)
    if kind == "national_id":
        return ~m.rlike(r"^(?:000|666|9)") & ~m.rlike(r"-00-|-0000$")
    return F.lit(True)


def _ends(widths: Column) -> Column:
    """Running sums of an array, in two levels so that long arrays don't cost their square."""
    add = lambda a, x: a + x
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(widths) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(widths, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add))
    return F.struct(widths.alias("w"), F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), add)).alias("base"))


def _with_matches(df: DataFrame, text: str, kinds, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds, for each kind, its matches and (if there are any) the pieces of text between them."""
    t = F.col(text)
    for k in kinds:
        found = F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))
        df = df.withColumn(names[k.name][0], F.when(t.contains(k.needs), found) if k.needs else found)
    return df.withColumns({names[k.name][1]: F.when(F.size(names[k.name][0]) > 0, F.split(t, k.pattern, -1)) for k in kinds})


def _item(gaps: Column, reach: int):
    """A match with its width, that of the piece in front of it, and its surroundings."""

    def item(m, i):
        return F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"), m.alias("m"), F.right(F.get(gaps, i), F.lit(reach)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(reach)).alias("after"))

    return item


def _placed(k: Kind, order: int, sums: Column):
    """Position, score and confirmation of the i-th match of a kind."""

    def placed(x, i):
        inside = F.aggregate(F.slice(sums["w"], i - i % _BLOCK + 1, i % _BLOCK + 1), F.lit(0), lambda a, y: a + y)
        end = F.get(sums["base"], F.floor(i / _BLOCK).cast("int")) + inside
        return F.struct((end - x["n"]).alias("start"), F.lit(order).alias("order"), end.alias("end"), _score(k, x["before"], x["after"]).alias("score"), _confirmed(k.name, x["m"]).alias("ok"))

    return placed


def _replaced(k: Kind, gaps: Column, reach: int, threshold: float):
    """The piece of text in front of the i-th match, and the match or what stands for it."""

    def piece(m, i):
        ok = _confirmed(k.name, m)
        if not k.base:
            ok = ok & (_score(k, F.right(F.get(gaps, i), F.lit(reach)), F.left(F.get(gaps, i + 1), F.lit(reach))) >= threshold)
        return F.concat(F.get(gaps, i), F.when(ok, f"<{k.name.upper()}>").otherwise(m))

    return piece


def _score(k: Kind, before: Column, after: Column) -> Column:
    near = before.rlike(k.context) | after.rlike(k.context)
    doubt = before.rlike(_DOUBT) | after.rlike(_DOUBT)
    return F.round(F.lit(k.score) + F.when(near, k.bonus).otherwise(0.0) - F.when(doubt, k.malus).otherwise(0.0), 2)


def find(docs: DataFrame, *, threshold: float = 0.5, reach: int = 48) -> DataFrame:
    """Personal data in ``docs(doc_id, text)``: ``doc_id, spans``.

    ``spans`` is an array of ``start, end`` (code points, end exclusive), ``kind`` and ``score``,
    ordered by start, then by kind as in ``KINDS``. A span counts if its kind's rule confirms it
    and, unless the kind is a base kind, its score reaches ``threshold``.

    A null or empty text has no spans, a repeated row is reported again, an empty table gives no
    rows, other columns are ignored. There is no shuffle.
    """
    names = {k.name: (f"m_{k.name}", f"g_{k.name}") for k in KINDS}
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = _with_matches(df, "text", KINDS, names)
    df = df.select("doc_id", *[c for pair in names.values() for c in pair])
    df = df.withColumns({f"i_{n}": F.transform(F.col(m), _item(F.col(g), reach)) for n, (m, g) in names.items()})
    df = df.select("doc_id", *[F.when(F.size(f"i_{n}") > 0, F.col(f"i_{n}")).alias(f"i_{n}") for n in names])
    df = df.withColumns({f"w_{n}": F.transform(f"i_{n}", lambda x: x["gap"] + x["n"]) for n in names})
    df = df.withColumns({f"s_{n}": _ends(F.col(f"w_{n}")) for n in names})
    none = F.array().cast("array<struct<start:int,order:int,end:int,score:double,ok:boolean>>")
    arrays = []
    for order, k in enumerate(KINDS):
        every = F.transform(F.col(f"i_{k.name}"), _placed(k, order, F.col(f"s_{k.name}")))
        sure = F.filter(every, lambda s: s["ok"]) if k.base else F.filter(every, lambda s: s["ok"] & (s["score"] >= threshold))
        arrays.append(F.coalesce(sure, none))
    named = F.array(*[F.lit(k.name) for k in KINDS])
    every = F.array_sort(F.concat(*arrays))
    return df.select("doc_id", every.alias("every")).select(
        "doc_id", F.transform("every", lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), F.get(named, s["order"]).alias("kind"), s["score"].alias("score"))).alias("spans")
    )


def redact(docs: DataFrame, *, threshold: float = 0.5, reach: int = 48) -> DataFrame:
    """``docs`` with each confirmed span of ``text`` replaced by its kind in angle brackets, and ``n_chars`` (if present) counted again.

    Kinds are replaced one after the other, those that can contain others first. All rows stay; a
    null text stays null; other columns are untouched whatever their names.
    """
    matches, gaps = temporary(docs, "pii_matches"), temporary(docs, "pii_gaps")
    df, by_name = docs, {k.name: k for k in KINDS}
    for n in ("email", "iban", "phone", "card", "national_id", "ip"):
        k = by_name[n]
        df = _with_matches(df, "text", [k], {n: (matches, gaps)})
        rebuilt = F.concat(F.array_join(F.transform(matches, _replaced(k, F.col(gaps), reach, threshold)), ""), F.element_at(gaps, -1))
        df = df.withColumn("text", F.when(F.size(matches) > 0, rebuilt).otherwise(F.col("text"))).drop(matches, gaps)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, all spans as text, and their scores in the same order."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{n}") for n in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
