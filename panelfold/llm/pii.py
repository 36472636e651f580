"""Personal data: patterns propose, checksums confirm, nearby words adjust the score."""

from pyspark.sql import Column, DataFrame, functions as F

from panelfold.llm import spans as S
from panelfold.session import materialize

# Kinds in order; the first four stay whatever their score.
KINDS = ["email", "ip", "card", "phone", "iban", "account"]
BASE = 4
# The same leftmost matches as the plain patterns, written so that no match is
# searched twice: a run is entered at its start or where the last match ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ACCOUNT = r"(?<![A-Za-z0-9.+-])[0-9]{8,13}(?![A-Za-z0-9-])"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# Words that make a kind likelier in the 40 characters before it.
WORDS = {
    "email": "e-?mail|mail|contact|correo|courriel",
    "ip": "ip|address|server|host|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "account": "account|acct|konto|kontonummer|compte|cuenta|passport|ssn|insurance",
}
# Score of a bare match, what its checksum adds, what a word nearby adds; reported
# from ``LEAST`` on.
SCORES = {"email": (0.7, 0.0, 0.2), "ip": (0.5, 0.2, 0.2), "card": (0.3, 0.5, 0.2),
          "phone": (0.5, 0.2, 0.2), "iban": (0.2, 0.6, 0.2), "account": (0.2, 0.0, 0.4)}
LEAST = 0.5


def _digits(shown: Column) -> Column:
    return F.regexp_replace(shown, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The card checksum: every second digit from the right counts double."""
    def add(total, k):
        d = F.substr(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        doubled = F.when(k % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + doubled
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(shown: Column) -> Column:
    """The bank account checksum: letters count 10 to 35, the first four signs go last."""
    plain = F.regexp_replace(shown, " ", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    signs = F.split(turned, "")
    order = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def add(total, sign):
        value = F.position(sign, order) - 1
        return F.when(sign == "", total).otherwise(
            (total * F.when(value > 9, 100).otherwise(10) + value) % 97)
    return F.aggregate(signs, F.lit(0), add) == 1


def _card(shown):
    digits = _digits(shown)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _iban(shown):
    return F.when(F.length(F.regexp_replace(shown, " ", "")).between(15, 34), mod97(shown)).otherwise(False)


def _scored(found: Column, kind: int, confirmed: bool) -> Column:
    """Spans with a score: pattern, checksum, and words nearby."""
    name = KINDS[kind]
    bare, proven, near = SCORES[name]
    pattern = rf"(?iu)\b(?:{WORDS[name]})\b"
    return F.transform(found, lambda s: s.withField("score", F.round(
        F.lit(bare + (proven if confirmed else 0.0))
        + F.when(s["before"].rlike(pattern), near).otherwise(0.0), 2)))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of start, kind, end, by start then kind)
    and ``scored`` (spans with text, context and score) of every row.

    Base spans are e-mail addresses, IPv4 addresses with parts up to 255, card
    numbers of 14 to 19 digits that pass Luhn's check, and phone numbers of 10 to
    15 digits; they stay whatever their score. The method adds bank account numbers
    (IBAN) that pass the mod-97 check and digit runs whose context names an account. Null
    texts count as empty; null and repeated ids pass through; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [
        _scored(S.find(text, EMAIL, 0), 0, True),
        _scored(S.find(text, IP, 1, lambda m: m.rlike(_OCTETS)), 1, True),
        _scored(S.find(text, CARD, 2, _card), 2, True),
        _scored(S.find(text, PHONE, 3, lambda m: F.length(_digits(m)).between(10, 15)), 3, True),
        _scored(S.find(text, IBAN, 4, _iban), 4, True),
        _scored(S.find(text, ACCOUNT, 5), 5, False)]
    rows = docs.select("doc_id", *[f.alias(f"_{k}") for k, f in enumerate(found)])
    kept = [F.filter(F.col(f"_{k}"), lambda s: s["score"] >= LEAST) if k >= BASE else F.col(f"_{k}")
            for k in range(len(KINDS))]
    # Written once: the patterns would else run again for every use of a column.
    rows = materialize(rows.select("doc_id", *[c.alias(f"_{k}") for k, c in enumerate(kept)]), "pii")
    parts = [F.col(f"_{k}") for k in range(len(KINDS))]
    return rows.select("doc_id", *[S.count(parts[k]).alias(f"n_{KINDS[k]}") for k in range(len(KINDS))],
                       S.placed(*parts[:BASE]).alias("base"), S.placed(*parts).alias("spans"),
                       F.concat(*parts).alias("scored"))
