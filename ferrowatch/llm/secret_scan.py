"""Secret scan with linking of multipart credentials, in DataFrame expressions only.

Strong patterns are reported wherever they match. Weak ones (an account name, a random-looking
run, an endpoint) are common in harmless text; they are reported only when the parts that would
complete a credential stand within reach. The link is an interval join of the parts of a document
on their positions: parts are rows, and a range frame over the positions counts, for each of
them, the complementary parts in its scope, so no pairs are made.

Positions come from the lengths of what a pattern matches and of what lies between: a match
starts where the running sum of both ends. Texts without a trace of any pattern are settled in
place and travel as one short row.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted, whole

# The base patterns. The lengths of the second and third are their minimum; runs
# are matched whole, so a shorter run cannot match further on either.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# The weak patterns and the reach of their scopes, in characters.
ACCOUNT_WORDS = ("user", "login", "client", "account", "access_key", "accesskey")
ACCOUNT = (
    r"(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]{3,}"
)
RANDOM = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"
SCOPE = 300


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: bool
    role: str


# In the order in which spans that start together are listed.
KINDS = (
    Kind("assign", ASSIGN, True, "secret"),
    Kind("access", ACCESS, True, "identifier"),
    Kind("hex", HEX, True, "secret"),
    Kind("account", ACCOUNT, False, "identifier"),
    Kind("random", RANDOM, False, "secret"),
    Kind("endpoint", ENDPOINT, False, "endpoint"),
)


def _holds(kind: Kind, match: Column) -> Column:
    """Whether a match counts, beyond its pattern."""
    if kind.name == "assign":
        return F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_VALUE
    if kind.name == "random":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def _matches(number: int, text: Column) -> Column:
    """(kind, gap, length, holds) of each match, in order; gap is what lies before it."""
    kind = KINDS[number]
    found = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda gap, match: F.struct(
            F.lit(number).alias("kind"),
            F.char_length(gap).alias("gap"),
            F.char_length(match).alias("length"),
            _holds(kind, match).alias("holds"),
        ),
    )
    return F.filter(found, lambda match: match["length"].isNotNull())


def _any(text: Column, words) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found |= text.contains(word)
    return found


def secret_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): one row per document, its spans by start and then by kind.

    A span is (kind, start, end, base) in code points, its end exclusive. Matches of one kind do
    not overlap; kinds may. A null text has no spans. Rows that repeat an id stay apart, a null id
    is kept; other columns are not read. An empty table stays empty.
    """
    body, lowered = F.col("body"), F.col("lowered")
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), whole(text).alias("body"))
    rows = rows.withColumn("lowered", F.lower("body")).select(
        F.monotonically_increasing_id().alias("uid"),
        "id",
        "body",
        _any(lowered, KEYWORDS).alias("assigns"),
        body.contains("AKIA").alias("accesses"),
        body.rlike(HEX).alias("hexes"),
        _any(lowered, ACCOUNT_WORDS).alias("accounts"),
    )
    # Every weak part needs an identifier, so a text without one has no weak parts to look for.
    weak = F.col("accesses") | F.col("accounts")
    traces = [F.col("assigns"), F.col("accesses"), F.col("hexes"), F.col("accounts"), weak, weak]
    # Typed as the matches are, for texts that are not searched.
    nothing = F.expr("array_repeat(struct(0 AS kind, 0 AS gap, 0 AS length, true AS holds), 0)")
    found = F.concat(
        *[F.when(trace, _matches(n, body)).otherwise(nothing) for n, trace in enumerate(traces)]
    )
    matches = (
        rows.select("uid", "id", F.posexplode_outer(found).alias("place", "match"))
        .select("uid", "id", "place", "match.*")
        # All that follows is per document.
        .repartition("uid")
    )
    in_kind = Window.partitionBy("uid", "kind").orderBy("place")
    end = F.sum(F.col("gap").cast("long") + F.col("length")).over(
        in_kind.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = matches.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    placed = placed.withColumn("held", F.coalesce("holds", F.lit(False)))

    def of(property_of_kind) -> Column:
        return F.element_at(
            F.array(*[F.lit(property_of_kind(kind)) for kind in KINDS]), F.col("kind") + 1
        )

    placed = placed.withColumn("base", of(lambda k: k.base)).withColumn("role", of(lambda k: k.role))
    scope = Window.partitionBy("uid").orderBy("start").rangeBetween(-SCOPE, SCOPE)
    before = (
        Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    )
    near = {
        role: F.count_if(F.col("held") & (F.col("role") == role)).over(scope)
        for role in ("identifier", "secret")
    }
    complete = (
        F.when(F.col("role") == "secret", near["identifier"] > 0)
        .when(F.col("role") == "identifier", near["secret"] > 0)
        .otherwise((near["identifier"] > 0) & (near["secret"] > 0))
    )
    # A weak part inside a strong one says nothing new.
    covered = F.max(F.when(F.col("held") & F.col("base"), F.col("end"))).over(before)
    linked = complete & (F.col("start") >= F.coalesce(covered, F.lit(0)))
    reported = placed.withColumn("reported", F.col("held") & (F.col("base") | linked))
    span = F.struct("start", "kind", "end", "base")
    spans = F.sort_array(F.collect_list(F.when(F.col("reported"), span)))
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    named = F.transform(
        spans,
        lambda s: F.struct(
            F.element_at(names, s["kind"] + 1).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["base"].alias("base"),
        ),
    )
    return reported.groupBy("uid", "id").agg(named.alias("spans")).select(
        F.col("id").alias(doc_id), "spans"
    )


def listed(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
