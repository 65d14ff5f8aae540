"""Secret scans by linking the parts of a credential, with DataFrame functions only.

Strong finds are reported as they are: assignments, access identifiers and long hex runs. Weak
candidates (other long tokens, user names, endpoints) are reported only within reach of a complementary
part: a weak token needs an identifier or an endpoint, a user name and an endpoint need a secret.
Reach is a scope of ``SCOPE`` code points between the nearer ends of the two spans.

Positions come from the regular expressions' matches and the lengths of the text between them, summed
up in order. The link is an interval join: spans go to all cells of ``SCOPE`` code points that their
scope touches, and meet by (row, cell), so a text with many parts has only neighbours compared.

Rows: a null text is empty and has no spans. Every row gives one result row, repeated ones too:
rows are numbered in the written table of matches. Positions are code points, ends exclusive. A
column named like a result's is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from keyferry.llm.common import table
from keyferry.scratch import settle

SCOPE = 200
#: The three strong kinds. The third value is the least length of group 1, if there is one.
BASE = (
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
    ),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
)
WEAK = (
    ("secret", r"[A-Za-z0-9+/_-]{20,}", 0),
    (
        "user",
        r"""(?i:user|login|client_?id|account|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]+""",
        0,
    ),
    (
        "endpoint",
        r"""https?://[^\x00-\x20"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}""",
        0,
    ),
)
KINDS = [kind for kind, *_ in BASE + WEAK]
ROLE = {
    "assign": "secret",
    "access": "identifier",
    "hex": "secret",
    "secret": "secret",
    "user": "identifier",
    "endpoint": "endpoint",
}


def _matches(text: Column, kind: str, pattern: str, least: int) -> Column:
    """The kind's matches in order: length of the text before each, its own length, and whether it
    counts. Null if there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    if least:
        counts = lambda m: F.length(F.regexp_extract(m, pattern, 1)) >= least
    elif kind == "secret":
        counts = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    else:
        counts = lambda m: F.lit(True)
    match = F.zip_with(
        F.slice(gaps, 1, F.size(found)),
        found,
        lambda gap, m: F.struct(
            F.length(gap).alias("gap"), F.length(m).alias("len"), counts(m).alias("counts")
        ),
    )
    return F.when(
        text.rlike(pattern),
        F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), match.alias("matches")),
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``row`` (its number) and ``parts`` (matches by kind) instead of the text; written,
    so that the numbers stay."""
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.array_compact(F.array(*[_matches(whole, *kind) for kind in BASE + WEAK]))
    kept = [F.col(c) for c in docs.columns if c not in (text, "row", "parts")]
    return settle(
        docs.select(*kept, F.monotonically_increasing_id().alias("row"), parts.alias("parts")),
        "secret-parts",
    )


def _spans(scanned: DataFrame) -> DataFrame:
    """row, kind_no, start, end of every match that counts."""
    each = scanned.select("row", F.inline("parts")).select(
        "row", "kind_no", F.posexplode("matches").alias("nth", "m")
    )
    before = F.sum(F.col("m.gap") + F.col("m.len")).over(
        Win.partitionBy("row", "kind_no").orderBy("nth")
    )
    return (
        each.withColumn("end", before)
        .where("m.counts")
        .select("row", "kind_no", (F.col("end") - F.col("m.len")).alias("start"), "end")
    )


def _cells(spans: DataFrame, margin: int, scope: int) -> DataFrame:
    return spans.withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor((F.col("start") - margin) / scope), F.floor((F.col("end") + margin) / scope)
            )
        ),
    )


def linked_spans(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, kind_no, start, end: all strong spans, and the weak ones that have their complement."""
    spans = settle(_spans(scanned), "spans")
    n_base = len(BASE)
    role = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])])
    strong = spans.where(F.col("kind_no") < n_base)
    other = strong.select("row", *[F.col(c).alias(f"o_{c}") for c in ("start", "end")])
    weak = spans.where(F.col("kind_no") >= n_base)
    # A weak candidate inside a strong span is that span.
    inside = (
        _cells(other.select("row", F.col("o_start").alias("start"), F.col("o_end").alias("end")), 0, scope)
        .select("row", "cell", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
        .alias("o")
    )
    mine = _cells(weak, 0, scope).alias("w")
    covered = mine.join(
        inside,
        (F.col("w.row") == F.col("o.row"))
        & (F.col("w.cell") == F.col("o.cell"))
        & (F.col("w.start") < F.col("o.o_end"))
        & (F.col("o.o_start") < F.col("w.end")),
        "left_semi",
    ).select("row", "kind_no", "start", "end").distinct()
    free = settle(
        weak.join(covered, ["row", "kind_no", "start", "end"], "left_anti"), "weak-candidates"
    )
    parts = strong.unionByName(free).withColumn("role", role[F.col("kind_no")])
    partner = (
        _cells(parts, 0, scope)
        .select("row", "cell", *[F.col(c).alias(f"o_{c}") for c in ("role", "start", "end")])
        .alias("o")
    )
    seeker = _cells(free, scope, scope).withColumn("role", role[F.col("kind_no")]).alias("w")
    near = (
        F.greatest("w.start", "o.o_start") - F.least("w.end", "o.o_end") <= scope
    )
    complement = (F.col("w.role") != F.col("o.o_role")) & (
        (F.col("w.role") == "secret") | (F.col("o.o_role") == "secret")
    )
    linked = (
        seeker.join(
            partner,
            (F.col("w.row") == F.col("o.row"))
            & (F.col("w.cell") == F.col("o.cell"))
            & near
            & complement,
            "left_semi",
        )
        .select("row", "kind_no", "start", "end")
        .distinct()
    )
    return strong.unionByName(linked)


def found_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` without its text, with ``spans``: array of (start, kind_no, end, kind), sorted."""
    scanned = scan(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = (
        linked_spans(scanned, scope)
        .groupBy("row")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("start", "kind_no", "end", names[F.col("kind_no")].alias("kind"))
                )
            ).alias("spans")
        )
    )
    none = F.expr("cast(array() as array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>)")
    return (
        scanned.drop("parts", "spans")
        .join(spans, "row", "left")
        .withColumn("spans", F.coalesce("spans", none))
        .drop("row")
    )


def written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``n_chars``, if there, is counted anew."""
    found = (
        found_secrets(docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text"))
        .where(F.size("spans") > 0)
        .groupBy("doc_id", "_hash")
        .agg(F.first("spans").alias("_spans"))
        .withColumnRenamed("doc_id", "_id")
    )
    start = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    joined = F.aggregate(
        "_spans",
        start,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    pieces = F.expr(
        "transform(sequence(0, size(_m)), i -> substring(doc.text, "
        "cast(if(i = 0, 0, _m[i - 1].end) + 1 as int), "
        "cast(if(i = size(_m), length(doc.text), _m[i].start) - if(i = 0, 0, _m[i - 1].end) as int)))"
    )
    out = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("_h")).join(
        found.select("_id", F.col("_hash").alias("_h2"), joined.alias("_m")),
        F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_h2")),
        "left",
    )
    text = F.when(F.col("_m").isNull(), F.col("doc.text")).otherwise(F.array_join(pieces, mark))
    out = out.withColumn("doc", F.col("doc").withField("text", text))
    if "n_chars" in docs.columns:
        changed = F.length("doc.text").cast(docs.schema["n_chars"].dataType)
        n_chars = F.when(F.col("_m").isNull(), F.col("doc.n_chars")).otherwise(changed)
        out = out.withColumn("doc", F.col("doc").withField("n_chars", n_chars))
    return out.select("doc.*")


def op8_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The same in SQL: positions by splitting at matches, links by comparing starts and ends."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    scans = "\nunion all\n".join(
        f"select doc_id, {i} as kind_no, regexp_extract_all(text, {quoted(p)}) as found, "
        f"string_split_regex(text, {quoted(p)}) as gaps, "
        + (f"regexp_extract_all(text, {quoted(p)}, 1)" if least else "[]::varchar[]")
        + f" as inner_part, {least} as least from d"
        for i, (_, p, least) in enumerate(BASE + WEAK)
    )
    role = "case " + " ".join(f"when kind_no = {i} then '{ROLE[k]}'" for i, k in enumerate(KINDS)) + " end"
    name = "case " + " ".join(f"when kind_no = {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
    text = f"string_agg({name} || ':' || s || ':' || e, ',' order by s, kind_no)"
    counts = ", ".join(
        f"count(*) filter (where kind_no = {i}) as n_{kind}" for i, (kind, *_) in enumerate(BASE)
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
scans as ({scans}),
each as (
  select doc_id, kind_no, found, gaps, inner_part, least, unnest(range(1, len(found) + 1)) as i
  from scans where len(found) > 0
), spans as (
  select doc_id, kind_no, {role} as role,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as s,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + list_sum(list_transform(found[1:i], lambda x: length(x))) as e
  from each
  where (least = 0 or length(inner_part[i]) >= least)
    and (kind_no <> 3 or (regexp_matches(found[i], '[0-9]') and regexp_matches(found[i], '[A-Za-z]')))
), base as (select * from spans where kind_no < 3),
free as (
  select * from spans w where kind_no >= 3 and not exists (
    select 1 from base b where b.doc_id = w.doc_id and w.s < b.e and b.s < w.e)
), parts as (select * from base union all select * from free),
kept as (
  select doc_id, kind_no, s, e from base
  union all
  select doc_id, kind_no, s, e from free w where exists (
    select 1 from parts p where p.doc_id = w.doc_id and p.role <> w.role
      and (p.role = 'secret' or w.role = 'secret')
      and greatest(p.s, w.s) - least(p.e, w.e) <= {SCOPE})
), agg as (
  select doc_id, {counts},
    string_agg({name} || ':' || s || ':' || e, ',' order by s, kind_no) filter (where kind_no < 3) as b,
    {text} as a
  from kept group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
  coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
from d left join agg using (doc_id)
"""


OP8_SQL = _sql()
