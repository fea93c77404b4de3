"""JSON Schema contracts compiled to column expressions: every violation of every document in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a variant's own type must match to be of a JSON Schema type.
_TYPES = {
    "null": "^VOID$",
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "object": "^OBJECT",
    "array": "^ARRAY",
}

KNOWN = {"type", "enum", "const", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "anyOf", "$ref", "$defs"}
NOTES = {"$schema", "$id", "title", "description", "format"}

_NONE = "array<string>"


def _says(bad: Column, text: str | Column) -> Column:
    """``text`` in an array where ``bad`` holds, an empty array elsewhere."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(F.coalesce(bad, F.lit(False)), F.array(text)).otherwise(F.array().cast(_NONE))


def _shown(values: list) -> str:
    return ", ".join("null" if v is None else str(v) for v in values)


def problems(value: Column, schema: dict, at: str = "$", defs: dict | None = None) -> Column:
    """An array of texts, one for each way in which a variant breaks ``schema``; empty if it keeps it.

    Knows types, enum, const, pattern, bounds, required, properties, additionalProperties false,
    items, their number, anyOf and references to $defs; formats and descriptions are notes. A
    keyword that is not known is an error: it would otherwise pass unchecked.
    """
    defs = schema.get("$defs", defs or {})
    if unknown := set(schema) - KNOWN - NOTES:
        raise ValueError(f"{at}: unknown keyword {', '.join(sorted(unknown))}")
    if "$ref" in schema:
        name = schema["$ref"].removeprefix("#/$defs/")
        if name not in defs:
            raise ValueError(f"{at}: no definition {schema['$ref']}")
        return problems(value, defs[name], at, defs)
    kind = F.schema_of_variant(value)
    found = []
    if "anyOf" in schema:
        fits = [F.size(problems(value, s, at, defs)) == 0 for s in schema["anyOf"]]
        some = fits[0]
        for f in fits[1:]:
            some = some | f
        found.append(_says(~some, f"{at}: none of the allowed forms"))
    of_kind = lambda k: kind.rlike(_TYPES[k])
    allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if allowed is not None:
        texts = [str(v) for v in allowed if v is not None and not isinstance(v, bool)]
        known = F.coalesce(value.cast("string").isin(texts), F.lit(False))
        if None in allowed:
            known = known | of_kind("null")
        found.append(_says(~known, f"{at}: not one of {_shown(allowed)}"))
    if "pattern" in schema:
        found.append(_says(of_kind("string") & ~value.cast("string").rlike(schema["pattern"]), f"{at}: does not match {schema['pattern']}"))
    number = F.try_variant_get(value, "$", "double")
    for word, breaks in (("minimum", lambda n, b: n < b), ("maximum", lambda n, b: n > b), ("exclusiveMinimum", lambda n, b: n <= b), ("exclusiveMaximum", lambda n, b: n >= b)):
        if word in schema:
            found.append(_says(of_kind("number") & breaks(number, F.lit(float(schema[word]))), f"{at}: beyond {word} {schema[word]}"))
    if {"properties", "required", "additionalProperties"} & set(schema):
        own = F.when(of_kind("object"), F.map_keys(value.cast("map<string,variant>")))
        props = schema.get("properties", {})
        found += [_says(~F.array_contains(own, name), f"{at}.{name}: missing") for name in schema.get("required", [])]
        for name, inner in props.items():
            there = F.coalesce(F.array_contains(own, name), F.lit(False))
            found.append(F.when(there, problems(value.cast("map<string,variant>")[name], inner, f"{at}.{name}", defs)).otherwise(F.array().cast(_NONE)))
        if schema.get("additionalProperties", True) is False:
            extra = F.array_except(own, F.array(*[F.lit(n) for n in props]).cast(_NONE))
            found.append(F.coalesce(F.transform(extra, lambda k: F.concat(F.lit(f"{at}."), k, F.lit(": not allowed"))), F.array().cast(_NONE)))
    if {"items", "minItems", "maxItems"} & set(schema):
        cells = F.when(of_kind("array"), value.cast("array<variant>"))
        for word, breaks in (("minItems", lambda n, b: n < b), ("maxItems", lambda n, b: n > b)):
            if word in schema:
                found.append(_says(cells.isNotNull() & breaks(F.size(cells), F.lit(schema[word])), f"{at}: beyond {word} {schema[word]}"))
        if schema.get("items") is False:
            found.append(_says(cells.isNotNull() & (F.size(cells) > 0), f"{at}: items are not allowed"))
        elif schema.get("items"):
            inner = F.transform(cells, lambda x: problems(x, schema["items"], f"{at}[]", defs))
            found.append(F.coalesce(F.flatten(inner), F.array().cast(_NONE)))
    rest = F.concat(*found) if found else F.array().cast(_NONE)
    if "type" not in schema:
        return rest
    kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
    fits = of_kind(kinds[0])
    for k in kinds[1:]:
        fits = fits | of_kind(k)
    return F.when(F.coalesce(fits, F.lit(False)), rest).otherwise(F.array(F.lit(f"{at}: not {' or '.join(kinds)}")))


def document_problems(docs: DataFrame, schema: dict, text: str = "document") -> DataFrame:
    """``docs`` with ``problem``: a row for each violation of each JSON text; a text that is no JSON is one."""
    parsed = F.try_parse_json(F.col(text))
    found = F.when(parsed.isNull(), F.array(F.lit("$: not a document"))).otherwise(problems(parsed, schema))
    return docs.withColumn("problem", F.explode(found))


def contract_violations(docs: DataFrame, schema: dict, text: str = "document") -> DataFrame:
    """``problem, n``: each kind of violation and how often it occurs; no row if all documents keep the contract."""
    return document_problems(docs, schema, text).groupBy("problem").agg(F.count("*").alias("n"))
