"""Payloads in JSON: layers merged by presence, and redaction at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.functions.scalars import redact


def merged(rows: DataFrame, key: str, layers: list[str]) -> DataFrame:
    """(key, name, value, layer): the members of the JSON objects in the layers' columns; of a name the last layer that has it counts, also when it has null there.

    value is JSON text. A layer that is null, no JSON or no object has no members. Objects within are values like others: they are
    taken whole. Members of hot keys are as many as a payload has; a name's layers are compared by a maximum.
    """
    body = F.explode(F.array(*[F.struct(F.lit(i).alias("layer"), F.col(c).alias("body")) for i, c in enumerate(layers)]))
    each = rows.select(key, body.alias("l")).where(F.ltrim(F.col("l.body")).startswith("{"))
    members = each.select(key, F.col("l.layer").alias("layer"), F.explode(F.from_json("l.body", "map<string, variant>")).alias("name", "member"))
    text = members.select(key, "layer", "name", F.coalesce(F.to_json("member"), F.lit("null")).alias("value"))
    return text.groupBy(key, "name").agg(F.max(F.struct("layer", "value")).alias("last")).select(key, "name", "last.value", F.col("last.layer").alias("layer"))


def rebuilt(members: DataFrame, key: str) -> DataFrame:
    """(key, payload): each key's members as one JSON object, by name."""
    pair = F.struct("name", F.concat(F.substring(F.to_json(F.array("name")), F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(":"), F.col("value")).alias("text"))
    return members.groupBy(key).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair))["text"], ","), F.lit("}")).alias("payload"))


def read_score(value: Column) -> Column:
    """A member's value as a number: null where it is absent or no number. An explicit null and an empty text are 0, true is 1."""
    text = F.when(value.startswith('"'), F.trim(F.substring(value, F.lit(2), F.length(value) - 2))).otherwise(value)
    number = F.when(value.isin("null", "false") | (text == ""), 0.0).when(value == "true", 1.0).otherwise(text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def redact_value(text: Column, users: tuple[str, ...] = ()) -> Column:
    """A text without secrets and addresses. What is a path, of files with their name only, else nothing; elsewhere names of users go."""
    out = redact(text)
    path = out.rlike(r"[A-Za-z]:\\|/")
    name = F.element_at(F.split(F.regexp_replace(out, r"[/\\]+$", ""), r"[/\\]"), -1)
    of_file = name.rlike(r"^.+\.[^.]+$") & ~name.rlike(r"^\.[^.]*$")
    plain = out
    for user in users:
        plain = F.replace(plain, F.lit(user), F.lit("<redacted_user>"))
    return F.when(path, F.when(of_file, F.concat(F.lit("<redacted_path>/"), name)).otherwise(F.lit("<redacted_path>"))).otherwise(plain)


def redact_json(body: Column, users: tuple[str, ...] = ()) -> Column:
    """A JSON text with every string value redacted, at any depth and in place; names of members and all else stay.

    The text is cut into string literals and what stands between them. Escaped quotes and backslashes are set aside for that (control
    characters, which JSON text can't hold, stand for them), so that a literal is a plain run and long ones cost linear time. What is no JSON is redacted as a text.
    """
    aside = F.replace(F.replace(body, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    tokens = F.regexp_extract_all(aside, F.lit(r'"[^"]*+"\s*+:?|[^"]++'), F.lit(0))

    def clean(token: Column) -> Column:
        literal = F.replace(F.replace(token, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
        end = F.length(F.rtrim(F.regexp_replace(literal, r"\s+$", "")))
        value = F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]
        text = F.to_json(F.array(redact_value(value, users)))
        safe = F.concat(F.substring(text, F.lit(2), F.length(text) - 2), F.substring(literal, end + 1, F.length(literal)))
        return F.when(token.startswith('"') & ~token.endswith(":") & value.isNotNull(), safe).otherwise(literal)

    return F.when(F.try_parse_json(body).isNotNull(), F.array_join(F.transform(tokens, clean), "")).otherwise(redact_value(body, users))
