"""Records: construction, checks, ordered rules, revisions, prompts, blocks of rich text, batches and request guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import STRIP, normalized, rewritten, stable_id


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The value of the first rule (expression, value) that fits; null fits none."""
    cases = reduce(lambda c, r: c.when(text.rlike(r[0]), r[1]), rules, F.when(F.lit(False), F.lit(None).cast("string")))
    return cases.otherwise(otherwise)


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.nullif(rewritten(v, STRIP), F.lit("")) for v in values))


def violations(rules: dict[str, Column]) -> Column:
    """The names of the checks that a row fails; one that is null fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def unknown_keys(document: Column, known: list[str]) -> Column:
    """Keys of a JSON object that a closed schema does not name."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")), F.array(*map(F.lit, known))))


def sticky_context(label: Column, title: Column, note: Column) -> Column:
    """What each chunk of a document begins with."""
    return F.concat_ws("\n", F.concat(F.lit("Source: "), label), F.concat(F.lit("Title: "), title), note)


def document(source: Column, path: Column, suffix: Column, title: Column, text: Column) -> Column:
    """A document as a struct: identity from source, path and suffix; the file's stem where there is no title; tidy text."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.struct(stable_id(source, path, suffix).alias("document_id"), first_given(title, stem).alias("title"), normalized(text).alias("text"))


def json_text(fields: dict[str, Column]) -> Column:
    """A flat object of strings as JSON with its keys in order, blanks after colons and commas, null written as null."""
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    parts = [F.concat(F.lit(f'"{k}": '), F.when(fields[k].isNull(), "null").otherwise(quoted(fields[k]))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def revision(fields: dict[str, Column]) -> Column:
    return F.sha2(json_text(fields), 256)


#: What a candidate's metadata tells the ranker (fixed values).
RANK_METADATA = ("event_date", "research_date", "reported_event_date", "content_use", "source_kind", "evidence_access")


def rank_prompt(passages: DataFrame, requests: DataFrame, most_chars: int = 1800) -> DataFrame:
    """(request_id, prompt): a request's question, history and interpretation with its candidates as JSON, labelled C1, C2, …
    with the beginning of their texts and what their metadata tells; absent values are null.

    ``passages``: (request_id, place, title, source, url, text, metadata), metadata being a map; ``requests``: (request_id,
    question, history, interpretation, as_of, recent), history being an array of (role, text)."""
    told = F.struct(*(F.try_element_at("metadata", F.lit(k)).alias(k) for k in RANK_METADATA))
    item = F.struct(F.concat(F.lit("C"), F.col("place").cast("string")).alias("id"), "title", "source", "url", F.substring("text", 1, most_chars).alias("text"), told.alias("metadata"))
    packed = passages.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("p")))), lambda x: x["p"]).alias("passages"))
    whole = F.struct("question", "history", "interpretation", F.struct(F.col("as_of").cast("string").alias("as_of"), "recent").alias("scope_hint_only"), "passages")
    return requests.join(packed, "request_id").select("request_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("prompt"))


# How much a passage may be used, as the answer's prompt states it.
REFERENCE_ONLY = (
    "Reference-only use: publisher headline and short introduction only. Identify/cite the article or show a short supplied excerpt; "
    "do not summarize its full text or infer incident dates from publication dates."
)


def grounded_prompt(passages: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, prompt): the conversation so far where there is one, the question, and the passages as numbered blocks.

    ``passages``: (request_id, place, title, publisher, url, status, access, is_reference, text); ``requests``: (request_id,
    question, transcript). A request without passages has an empty list of blocks."""
    access = F.concat(F.lit("Research page-access record: "), F.col("access"), F.lit(". This describes the author's research; the original page was not re-fetched during ingestion."))
    note = F.when(F.col("is_reference"), REFERENCE_ONLY).when(F.coalesce("access", F.lit("")) != "", access).otherwise("")
    lines = [F.concat(F.lit("[S"), F.col("place").cast("string"), F.lit("]"))]
    lines += [F.concat(F.lit(label), F.coalesce(value, F.lit(absent))) for label, value, absent in (("Title: ", F.col("title"), ""), ("Publisher: ", F.col("publisher"), ""), ("URL: ", F.col("url"), ""), ("Legal or institutional status: ", F.nullif("status", F.lit("")), "Not specified"))]
    block = F.concat_ws("\n", *lines, note, F.lit("<evidence>"), F.coalesce("text", F.lit("")), F.lit("</evidence>"))
    blocks_of = passages.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("__blocks"))
    history = F.when(F.coalesce("transcript", F.lit("")) != "", F.concat(F.lit("Recent conversation (unverified context, never evidence):\n<conversation>\n"), F.col("transcript"), F.lit("\n</conversation>")))
    prompt = F.concat_ws("\n\n", history, F.concat(F.lit("Visitor question:\n"), F.col("question")), F.concat(F.lit("Evidence blocks:\n\n"), F.coalesce("__blocks", F.lit(""))))
    return requests.join(blocks_of, "request_id", "left").select("request_id", prompt.alias("prompt"))


def refusal(status: Column, body: Column) -> Column:
    """Why a request was refused, by its status and what its JSON body, if it is any, details."""
    detail = F.try_variant_get(F.try_parse_json(body), "$.detail", "string")
    quota = F.when(detail.isin("client_quota_exhausted", "daily_quota_exhausted"), detail)
    return F.when(status == 503, "unavailable").when(status == 429, F.coalesce(quota, F.lit("too_many_requests"))).otherwise("request_failed")


def in_order(answers: DataFrame, group: str, index: str, value: str, size: str) -> DataFrame:
    """(group, values): the answers of a batch by their index; one that is missing, repeated or beyond ``size`` is an error."""
    packed = answers.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("p"), F.max(size).alias("n"))
    whole = F.transform("p", lambda x: x["i"].cast("int")) == F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    values = F.transform("p", lambda x: x["v"])
    return packed.select(group, F.when(whole, values).otherwise(F.raise_error(F.lit("the answers of a batch are not whole")).cast(f"array<{answers.schema[value].dataType.simpleString()}>")).alias("values"))


def same_set(one: Column, two: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order and repeats; null equals only null."""
    return F.array_sort(F.array_distinct(one)).eqNullSafe(F.array_sort(F.array_distinct(two)))


def blocks(text: Column) -> Column:
    """Rich text as an array of (kind, items): blocks are divided by empty lines; one whose lines all begin with a dash or
    star is a list, with numbers an ordered list, else a paragraph of its joined lines."""

    def block(b: Column) -> Column:
        lines = F.filter(F.transform(F.split(b, "\n"), lambda x: rewritten(x, STRIP)), lambda x: x != "")
        bullets, numbers = F.forall(lines, lambda x: x.rlike(r"^[-*] ")), F.forall(lines, lambda x: x.rlike(r"^\d+[.)] "))
        items = F.transform(lines, lambda x: F.regexp_replace(x, r"^([-*]|\d+[.)]) +", ""))
        return F.struct(
            F.when(bullets, "list").when(numbers, "ordered").otherwise("paragraph").alias("kind"), F.when(bullets | numbers, items).otherwise(F.array(F.array_join(lines, " "))).alias("items")
        )

    cut = F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*\n\s*"), lambda b: rewritten(b, STRIP) != "")
    return F.transform(cut, block)


def batched(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Rows with their batch, counting from 0, of at most ``size`` in each group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size))


def origin(url: Column) -> Column:
    """Scheme, host and port that is not the scheme's own, in lower case; null for anything else than that."""
    bare = F.lower(rewritten(url, STRIP))
    plain = F.regexp_replace(F.regexp_replace(bare, r"^(https://[^/:]+):443$", "$1"), r"^(http://[^/:]+):80$", "$1")
    return F.when(plain.rlike(r"^https?://[a-z0-9.-]+(:\d+)?$"), plain)


def from_allowed_origins(requests: DataFrame, url: str, allowed: DataFrame) -> DataFrame:
    """Requests whose origin is among ``allowed`` (origin); a bounded table of settings."""
    known = allowed.select(origin(F.col("origin")).alias("__o")).distinct()
    return requests.withColumn("__o", origin(F.col(url))).join(known, "__o", "left_semi").drop("__o")
