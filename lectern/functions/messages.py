"""Chat messages, model names, JSON replies and cache keys, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each role's message looks like in a prompt.
ROLE_PREFIX = {"system": "[System]: ", "user": "", "assistant": "[Assistant]: "}


def prompt_piece(role: Column, content: Column) -> Column:
    """One message of a prompt; null for roles that prompts leave out."""
    role = F.coalesce(role, F.lit("user"))
    out = F.lit(None).cast("string")
    for name, prefix in ROLE_PREFIX.items():
        out = F.when(role == name, F.concat(F.lit(prefix), F.coalesce(content, F.lit("")))).otherwise(out)
    return out


def prompts(conversations: DataFrame) -> DataFrame:
    """conv_id and prompt: the messages of each conversation in order of turn, empty lines between."""
    pieces = conversations.withColumn("piece", prompt_piece(F.col("role"), F.col("text")))
    return pieces.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("turn", "piece")))), lambda p: p["piece"]), "\n\n").alias("prompt")
    )


def block_text(blocks: Column, glue: str) -> Column:
    """Texts of the text blocks of a message or reply, joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), glue)


def resolve_model(name: Column, known: dict[str, str], default: str = "opencode", alias: str = "localapi") -> Column:
    """provider/model: a known name, else its longest known prefix, else as written, else the default provider."""
    out = F.when(F.contains(name, F.lit("/")), F.regexp_replace(name, f"^{alias}/", f"{default}/")).otherwise(F.concat(F.lit(default + "/"), name))
    for key in sorted(known, key=lambda k: (len(k), k)):
        out = F.when(F.startswith(name, F.lit(key)), F.lit(known[key])).otherwise(out)
    for key, value in known.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out


def json_reply(c: Column | str) -> Column:
    """The first candidate in a reply that is JSON: all of it, a fenced block, outermost braces, outermost brackets."""
    c = F.col(c) if isinstance(c, str) else c
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    out = F.lit(None).cast("string")
    for candidate in (brackets, braces, fenced, c):
        trimmed = F.nullif(F.regexp_replace(candidate, r"^\s+|\s+$", ""), F.lit(""))
        out = F.when(F.try_parse_json(trimmed).isNotNull(), trimmed).otherwise(out)
    return out


def cache_key(**parts: Column) -> Column:
    """sha256 of the parts as JSON, names in alphabetical order. Include the week where it matters."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)
