"""Secret scans: parts of credentials linked by an interval join within scopes."""

from pyspark.sql import DataFrame, functions as F

from panelfold.llm import spans as S
from panelfold.session import materialize

# Kinds in order; the first three are reported by themselves.
KINDS = ["assign", "access", "hex", "identifier", "endpoint", "candidate"]
BASE = 3
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"   # a shorter run fails, and so does what starts inside it
HEX = r"[0-9a-f]{16,}"
# Weak parts: by themselves they mean nothing.
IDENTIFIER = (r"(?i)(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account_?id|access_?id|uid)"
              r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}")
ENDPOINT = r"(?i)\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh|s3)://[^\s\"'<>]{4,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
SCOPE = 200  # code points from the end of a part to the start of one that belongs to it

# Which parts make up a credential: identifier, secret, endpoint.
ROLES = {"access": "identifier", "identifier": "identifier", "assign": "secret", "hex": "secret",
         "candidate": "secret", "endpoint": "endpoint"}


def _mixed(shown):
    """A random-looking run: digits, capitals and small letters, no plain word."""
    return shown.rlike("[0-9].*[0-9]") & shown.rlike("[A-Z]") & shown.rlike("[a-z]")


def _others(role: str) -> list[str]:
    return [r for r in ("identifier", "secret", "endpoint") if r != role]


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows of ``parts`` (key, kind, role, start, end, weak) that are weak and complemented.

    An identifier needs a secret within ``scope`` and a candidate secret an
    identifier or an endpoint; an endpoint needs both. The distance is the gap between
    the two intervals. A semi-join on slices of the text (a part lies in all that it
    covers, a complementary part also in those within ``scope``) keeps it to the
    neighbourhood: no pair of parts is ever a row.
    """
    def slices(first, last):
        return F.explode(F.sequence(F.floor(first / scope).cast("int"), F.floor(last / scope).cast("int")))

    start, end = F.col("start"), F.col("end")
    near = parts.select(F.col("key").alias("k"), F.col("role").alias("r"), start.alias("from"), end.alias("to"),
                        slices(start - scope, end + scope).alias("s"))
    weak = parts.where("weak")

    def beside(rows, roles):
        other = near.where(F.col("r").isin(roles))
        return (rows.withColumn("slice", slices(start, end))
                .join(other, (F.col("key") == F.col("k")) & (F.col("slice") == F.col("s"))
                      & (start - F.col("to") <= scope) & (F.col("from") - end <= scope), "left_semi")
                .drop("slice").distinct())

    identifiers = beside(weak.where("role = 'identifier'"), ["secret"])
    secrets = beside(weak.where("role = 'secret'"), ["identifier", "endpoint"])
    endpoints = beside(beside(weak.where("role = 'endpoint'"), ["secret"]), ["identifier"])
    return identifiers.unionAll(secrets).unionAll(endpoints)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id``, the number of each base kind, ``base`` and ``spans`` (arrays of start,
    kind, end by start, then kind) and ``base_shown`` (base spans with their texts).

    Base spans (assignments of 12 or more signs, access ids of 18 or more, hex runs
    of 16 or more) always stay. Identifiers, endpoints and random-looking runs are
    weak: they are added only where complementary parts lie within ``scope``. Equal
    texts are linked once. Null texts count as empty; null and repeated ids pass
    through; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    found = [S.find(text, ASSIGN, 0, assign_value), S.find(text, ACCESS, 1), S.find(text, HEX, 2),
             S.find(text, IDENTIFIER, 3), S.find(text, ENDPOINT, 4), S.find(text, CANDIDATE, 5, _mixed)]
    rows = materialize(docs.select("doc_id", F.md5(text).alias("key"),
                                   *[f.alias(f"_{k}") for k, f in enumerate(found)]), "parts")
    parts = [F.col(f"_{k}") for k in range(len(KINDS))]
    # Only texts with a weak part and another one, each text once.
    some = F.size(F.concat(*parts[BASE:])) > 0
    several = F.size(F.concat(*parts)) > 1
    texts = (rows.where(some & several).groupBy("key")
             .agg(*[F.first(f"_{k}").alias(f"_{k}") for k in range(len(KINDS))]))
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    flat = materialize(
        texts.select("key", F.explode(F.concat(*parts)).alias("p"))
        .select("key", "p.kind", "p.start", "p.end", F.element_at(roles, F.col("p.kind") + 1).alias("role"),
                (F.col("p.kind") >= BASE).alias("weak")), "flat")
    # A weak run that overlaps a base span of the same role is that span.
    base = flat.where("not weak").select(F.col("key").alias("bk"), F.col("role").alias("br"),
                                         F.col("start").alias("bs"), F.col("end").alias("be"))
    slices = F.sequence(F.floor(F.col("bs") / scope), F.floor((F.col("be") - 1) / scope))
    mine = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)))
    covered = (flat.where("weak").withColumn("slice", mine)
               .join(base.withColumn("bslice", F.explode(slices)),
                     (F.col("key") == F.col("bk")) & (F.col("slice") == F.col("bslice"))
                     & (F.col("role") == F.col("br")) & (F.col("start") < F.col("be"))
                     & (F.col("bs") < F.col("end")), "left_semi")
               .select("key", "kind", "start").distinct())
    alone = materialize(flat.join(covered, ["key", "kind", "start"], "left_anti"), "alone")
    added = materialize(
        link(alone, scope).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
        .withColumnRenamed("key", "added_key"), "added")
    out = rows.join(added, F.col("key") == F.col("added_key"), "left")
    base_spans = S.placed(*parts[:BASE])
    return out.select(
        "doc_id", *[S.count(parts[k]).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        base_spans.alias("base"),
        F.when(F.col("added").isNull(), base_spans)
        .otherwise(F.array_sort(F.concat(base_spans, "added"))).alias("spans"),
        F.concat(*parts[:BASE]).alias("base_shown"))
