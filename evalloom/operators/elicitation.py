"""Records rendered for a language model, in arms that differ in one slot, and what comes back. No client is called here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.scalars import mask_phrases_of, shown
from evalloom.operators.ranking import ranking_metrics

#: What a slot without content shows, terms that name no condition, and marks of a refusal.
MASKED = "[condition withheld]"
GENERIC = ["healthy", "healthy volunteer", "healthy volunteers", "normal", "normal volunteers", "n/a", "na", "none", "unknown"]
REFUSALS = ["i cannot", "i can't", "i'm unable", "as an ai", "i won't", "i will not"]
ARMS = ("L0", "L1", "L2", "L3", "L4", "L5", "L7")


def listed(terms: Column, masked: str = MASKED) -> Column:
    return F.when(F.size(terms) > 0, F.array_join(terms, "; ")).otherwise(F.lit(masked))


def slot(arm: str, names: Column, codes: Column, headings: Column, described: Column, categories: Column, summary: Column, masked: str = MASKED) -> Column:
    """What an arm shows in the slot. L0 nothing, L1 names, L2 codes, L3 described codes, L4 headings, L5 categories, L7 names and summary.

    L6 has no source of descriptions and is refused, as is an arm of another name.
    """
    if arm not in ARMS:
        raise ValueError(f"no arm {arm!r}, there are {', '.join(ARMS)}")
    text = F.when(shown(summary) != "unknown", F.concat_ws(". ", listed(names, masked), shown(summary))).otherwise(listed(names, masked))
    return {"L0": F.lit(masked), "L1": listed(names, masked), "L2": listed(codes, masked), "L3": listed(described, masked), "L4": listed(headings, masked), "L5": listed(categories, masked), "L7": text}[arm]


def body(fields: dict[str, Column], scrubbed: set[str], phrases: Column, slot_label: str = "Condition", mark: str = " ") -> Column:
    """"label: value" lines up to the slot, which comes last; in the scrubbed fields `mark` replaces the record's own phrases."""
    lines = [F.concat(F.lit(f"{label}: "), mask_phrases_of(shown(value), phrases, mark) if label in scrubbed else shown(value)) for label, value in fields.items()]
    return F.concat(F.concat_ws("\n", *lines), F.lit(f"\n{slot_label}: "))


def prompt(question: Column, record: Column, contract: str) -> Column:
    return F.concat_ws("\n\n", question, record, F.lit(contract))


def broken_bodies(df: DataFrame, key: str, texts: dict[str, Column], slots: dict[str, Column]) -> DataFrame:
    """(key, arms): records whose text without the slot at its end isn't the same in all arms, or doesn't end with its slot. Empty if all is well."""
    rest = {a: F.when(F.endswith(t, slots[a]), F.substring(t, F.lit(1), F.length(t) - F.length(slots[a]))) for a, t in texts.items()}
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), r.alias("rest")) for a, r in rest.items()])
    first = next(iter(rest.values()))
    odd = F.transform(F.filter(arms, lambda x: ~x["rest"].eqNullSafe(first) | x["rest"].isNull()), lambda x: x["arm"])
    return df.select(key, odd.alias("arms")).where(F.size("arms") > 0)


def leaks(df: DataFrame, key: str, text: Column, terms: Column, generic: list[str] = GENERIC) -> DataFrame:
    """(key, term): terms of a record that its masked text still holds; generic words don't count."""
    each = df.select(key, text.alias("_text"), F.explode(F.array_distinct(terms)).alias("term"))
    return each.where((F.col("term") != "") & ~F.lower("term").isin(generic) & F.contains("_text", F.col("term"))).select(key, "term")


#: Providers by what a model's id holds, in the order in which they are tried, and where their records have things.
PROVIDERS = {"anthropic": ("anthropic",), "amazon_nova": ("nova",), "meta_llama": ("llama", "meta."), "deepseek": ("deepseek",)}
USAGE = {"anthropic": ("$.usage.input_tokens", "$.usage.output_tokens"), "amazon_nova": ("$.usage.inputTokens", "$.usage.outputTokens"), "meta_llama": ("$.prompt_token_count", "$.generation_token_count"), "deepseek": ("$.usage.prompt_tokens", "$.usage.completion_tokens")}
LLAMA = ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n")


def by_provider(provider: Column, cases: dict[str, Column]) -> Column:
    out = F.when(F.lit(False), next(iter(cases.values())))
    for name, value in cases.items():
        out = out.when(provider == name, value)
    return out


def provider_of(model: Column) -> Column:
    """The provider that a model's id names; an id that names none is an error."""
    name, out = F.lower(model), F.when(F.lit(False), F.lit(""))
    for provider, marks in PROVIDERS.items():
        out = out.when(F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(name, m)), provider)
    return out.otherwise(F.raise_error(F.concat(F.lit("no record format for model "), F.coalesce(model, F.lit("null")))))


def request_body(provider: Column, prompt: Column, temperature: Column, max_tokens: Column) -> Column:
    """The record's input as JSON: one user turn, in the provider's shape."""
    temperature, most = temperature.cast("double"), max_tokens.cast("int")
    turn = lambda content: F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages")
    shapes = {
        "anthropic": F.struct(F.lit("bedrock-2023-05-31").alias("anthropic_version"), most.alias("max_tokens"), temperature.alias("temperature"), turn(F.array(F.struct(F.lit("text").alias("type"), prompt.alias("text"))))),
        "amazon_nova": F.struct(turn(F.array(F.struct(prompt.alias("text")))), F.struct(most.alias("maxTokens"), temperature.alias("temperature")).alias("inferenceConfig")),
        "meta_llama": F.struct(F.concat(F.lit(LLAMA[0]), prompt, F.lit(LLAMA[1])).alias("prompt"), most.alias("max_gen_len"), temperature.alias("temperature")),
        "deepseek": F.struct(turn(prompt), most.alias("max_tokens"), temperature.alias("temperature")),
    }
    return by_provider(provider, {name: F.to_json(shape) for name, shape in shapes.items()})


def record_text(provider: Column, body: Column) -> Column:
    """The text that a record's output holds, its parts put together; empty where the shape is another."""
    part = "array<struct<type:string,text:string>>"
    parts = lambda path, wanted: F.array_join(F.transform(F.filter(F.from_json(F.get_json_object(body, path), part), wanted), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    first = F.get_json_object(body, "$.choices[0].message.content")
    cases = {
        "anthropic": parts("$.content", lambda x: x["type"] == "text"),
        "amazon_nova": parts("$.output.message.content", lambda x: F.lit(True)),
        "meta_llama": F.get_json_object(body, "$.generation"),
        "deepseek": F.coalesce(F.nullif(first, F.lit("")), F.get_json_object(body, "$.choices[0].text")),
    }
    return F.coalesce(by_provider(provider, cases), F.lit(""))


def record_usage(provider: Column, body: Column) -> tuple[Column, Column]:
    """Tokens in and out; 0 where a record doesn't say."""
    at = lambda k: F.coalesce(by_provider(provider, {name: F.get_json_object(body, paths[k]) for name, paths in USAGE.items()}).try_cast("bigint"), F.lit(0).cast("bigint"))
    return at(0), at(1)


def reassembled(asked: DataFrame, records: DataFrame, key: str, body_col: str, error_col: str, fallback: float = 0.5) -> DataFrame:
    """(key, status, proba): every asked row with its record's reply; a missing or failed record and a reply without a probability count as the fallback.

    Of records that repeat a key one counts: one without an error before others, then the greatest body.
    """
    rank = F.struct(F.col(error_col).isNull().alias("fine"), F.col(body_col).alias("body"), F.col(error_col).alias("error"))
    one = records.groupBy(key).agg(F.max(rank).alias("_r")).select(key, F.col("_r.body").alias(body_col), F.col("_r.error").alias(error_col))
    joined = asked.select(key).join(one, key, "left")
    value = F.get_json_object(body_col, "$.probability").try_cast("double")
    fine = value.between(0, 100)
    status = F.when(F.col(error_col).isNotNull(), "error").when(F.col(body_col).isNull(), "missing").when(fine, "ok").otherwise("unparsed")
    return joined.select(key, status.alias("status"), F.when((status == "ok"), value / 100).otherwise(F.lit(fallback)).alias("proba"))


def without_leaks(df: DataFrame, key: str, text: Column, terms: Column, generic: list[str] = GENERIC) -> DataFrame:
    """df itself if no text holds a term of its record; else an error that names some, before anything is asked."""
    found = leaks(df, key, text, terms, generic)
    some = [tuple(r) for r in found.limit(3).collect()]
    if some:
        raise ValueError(f"{found.select(key).distinct().count()} texts hold what they should mask, such as {some}")
    return df


def masking_curve(df: DataFrame, texts: dict[str, Column], score: Callable[[Column], Column], label: str) -> DataFrame:
    """(arm, place, ap, auroc, delta): each arm's texts scored and ranked, and its AP less that of the first arm."""
    arms = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(a).alias("arm"), score(t).cast("double").alias("_s")) for k, (a, t) in enumerate(texts.items())])
    long = df.select(F.col(label).alias("_y"), F.explode(arms).alias("e")).select("_y", "e.place", "e.arm", "e._s")
    found = ranking_metrics(long, ["place", "arm"], "_s", "_y")
    first = found.where("place = 0").select(F.col("ap").alias("_first"))
    return found.crossJoin(F.broadcast(first)).select("arm", "place", "ap", "auroc", (F.col("ap") - F.col("_first")).alias("delta"))  # one row


def cached_or_asked(prompts: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """prompts with reply and cached: the cache's reply where it has the key, the least of several; the others are what is left to ask."""
    known = cache.groupBy(key).agg(F.min("reply").alias("reply"))
    return prompts.join(known, key, "left").withColumn("cached", F.col("reply").isNotNull())


def unregistered(grid: DataFrame, plan: DataFrame, keys: list[str], repeats: str, default: int | None = None) -> DataFrame:
    """Rows of the grid whose number of repeats isn't exactly the plan's. Empty if all is well.

    Cells that the plan doesn't name must have the default, and are breaches without one. A plan row that repeats is one; a cell
    with several numbers may have any of them.
    """
    allowed = plan.groupBy(*keys).agg(F.collect_set(repeats).alias("_allowed"))
    named = F.coalesce(F.col("_allowed"), F.array(F.lit(default)) if default is not None else F.array().cast("array<int>"))
    fine = F.coalesce(F.exists(named, lambda x: x == F.col(repeats)), F.lit(False))
    return grid.join(allowed, keys, "left").where(~fine).select(*grid.columns)


def unattributed(calls: DataFrame, wanted: str, served: str) -> DataFrame:
    """Calls that weren't served by the model that was asked for."""
    return calls.where(~F.col(wanted).eqNullSafe(F.col(served)))


def rotated_choices(options: DataFrame, key: str, place: str, rotations: int) -> DataFrame:
    """(key, rotation, place, option place): the option at each place in every rotation; an option meets each place once."""
    return options.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(rotations - 1)))).withColumn("shown_at", F.pmod(F.col(place) + F.col("rotation"), F.lit(rotations)).cast("int"))


def unrotated(replies: DataFrame, key: str, place: str) -> DataFrame:
    """(key, place, p, top): mean probability of each option over the rotations, and whether it is the highest (first on ties)."""
    means = replies.groupBy(key, place).agg(F.avg("p").alias("p"))
    best = means.groupBy(key).agg(F.max(F.struct(F.col("p"), (-F.col(place)).alias("less"))).alias("b"))
    return means.join(best, key).select(key, place, "p", (-F.col(place) == F.col("b.less")).alias("top"))
