"""Personal data: patterns propose, checksums confirm, context words weigh.

Native: every step is a DataFrame expression. Patterns propose spans; Luhn's rule
confirms cards, mod-97 and the length of its country an account number (IBAN),
calendar rules a date, number rules a social security number. Each span then has a score: that of its kind,
more where words of its kind stand near, less where words do that speak of something
else (an order number, a version, an example).

Base kinds (email, ip, card, phone) are kept whatever their score. The method adds
spans of further kinds whose score reaches ``min_score``: account numbers need no
context, but lose to words against them; local phone numbers, dates of birth, social security
numbers and passport numbers are kept only where context speaks for them. Where
added spans of several kinds overlap, each is given.

Quantifiers are possessive and guarded on the left, so a long run of digits or
letters takes linear time; the matches are those of the contract's patterns.

Null texts are empty texts. Repeated rows each get their own, equal result. Null
ids stay as they are, extra columns stay, and columns of the input that are named
like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, matched, replacing, span_text, text_of

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL = r"(?<![0-9A-Za-z+.-])\(?0[0-9]{1,4}\)?[\x20/-]?[0-9]{2,4}[\x20-]?[0-9]{2,4}(?:[\x20-]?[0-9]{1,4})?(?![0-9A-Za-z])"
BIRTH = r"(?<![0-9A-Za-z.-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PASSPORT = r"(?<![0-9A-Za-z])[A-Z]{1,2}[0-9]{6,8}(?![0-9A-Za-z])"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local", "birth", "ssn", "passport")

#: Words that make a kind likelier when they stand near a span.
CONTEXT = {
    "email": "e-?mail|mail|contact|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|teléfono|téléphone",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "local": "phone|telephone|tel|call|mobile|fax|telefon|handy|teléfono|móvil|téléphone",
    "birth": "born|birth|birthday|dob|geboren|geburtsdatum|nacid[oa]|nacimiento|née?|naissance",
    "ssn": "ssn|social security|sozialversicherung|seguridad social|sécurité sociale",
    "passport": "passport|reisepass|ausweis|pasaporte|passeport",
}
#: Words that make any kind less likely.
AGAINST = "order|invoice|version|serial|isbn|sku|part number|example|sample|dummy|bestellung|rechnung|beispiel|pedido|factura|ejemplo|commande|facture|exemple"
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "local": 0.35, "birth": 0.3, "ssn": 0.4, "passport": 0.3}
FOR, LESS, NEAR = 0.3, 0.3, 40
#: Letters of an account number by country, of the registry of that standard.
IBAN_LETTERS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's rule."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    weighed = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(weighed, F.lit(0), lambda acc, v: acc + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, without blanks, leaves 1 by the mod-97 rule."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        v = F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    hit = s["hit"]
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda x: x.cast("double") <= 255)
    if kind == "card":
        d = _digits(hit)
        return F.length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        bare = F.replace(hit, F.lit(" "), F.lit(""))
        known = F.create_map(*[F.lit(x) for kv in IBAN_LETTERS.items() for x in kv])
        size = F.try_element_at(known, F.substring(bare, 1, 2))
        return F.length(bare).between(15, 34) & F.coalesce(F.length(bare) == size, F.lit(True)) & mod97(bare)
    if kind == "local":
        return F.length(_digits(hit)).between(7, 12)
    if kind == "birth":
        parts = F.transform(F.split(hit, "[-./]"), lambda x: x.cast("int"))
        days = F.filter(parts, lambda x: x < 1000)
        return F.forall(days, lambda x: x.between(1, 31)) & F.exists(days, lambda x: x <= 12)
    if kind == "ssn":
        return ~hit.rlike("^(000|666|9)") & ~F.contains(hit, F.lit("-00-")) & ~hit.endswith("0000")
    return F.lit(True)


def _scored(kind: str, s: Column) -> Column:
    near = F.concat(s["before"], F.lit(" "), s["after"])
    has = lambda words: near.rlike(rf"(?i)(?<!\p{{L}})(?:{words})(?!\p{{L}})")
    return F.lit(BASE_SCORE[kind]) + F.when(has(CONTEXT[kind]), FOR).otherwise(0.0) - F.when(has(AGAINST), LESS).otherwise(0.0)


def _confirmed(kind: str, rank: int) -> Column:
    """The valid spans of a kind, each with its score, ordered so that kinds sort first."""
    return F.transform(
        F.filter(f"_q_{kind}", lambda s: _valid(kind, s)),
        lambda s: F.struct(
            F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("hit"), F.round(_scored(kind, s), 2).alias("score")
        ),
    )


def find_pii(docs: DataFrame, min_score: float = 0.6) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base spans, and pii: array of (rank, start, end, kind, hit, score).

    Context is what stands within NEAR letters of a span, up to the next span of its kind.
    """
    df = docs.withColumn("_q_text", text_of(docs))
    text = F.col("_q_text")
    df = matched(
        df,
        {
            "email": (EMAIL, F.contains(text, F.lit("@"))),
            "ip": (IP, None),
            "card": (CARD, None),
            "phone": (PHONE, F.contains(text, F.lit("+"))),
            "iban": (IBAN, None),
            # these count only beside words that speak for them
            **{k: (p, text.rlike(rf"(?i)(?<!\p{{L}})(?:{CONTEXT[k]})(?!\p{{L}})")) for k, p in (("local", LOCAL), ("birth", BIRTH), ("ssn", SSN), ("passport", PASSPORT))},
        },
        "_q_text",
        NEAR,
    )
    df = df.withColumns({f"_q_{kind}": _confirmed(kind, rank) for rank, kind in enumerate(KINDS)})
    base = F.concat(*[f"_q_{k}" for k in BASE])
    added = F.filter(F.concat(*[f"_q_{k}" for k in KINDS[len(BASE) :]]), lambda s: s["score"] >= min_score)
    out = replacing(
        df,
        {f"n_{k}": F.size(f"_q_{k}").cast("long") for k in BASE} | {"base": F.array_sort(base), "pii": F.array_sort(F.concat(base, added))},
    )
    return out.drop("_q_text", *[f"_q_{k}" for k in KINDS])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the personal data of every document."""
    out = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",")
    return out.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("pii")).alias("spans"), scores.alias("scores")
    )
