"""Column functions for identifiers, tokens, keys, logits and text. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with Latin diacritics and the plain letters that stand for them.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýąćęłńśźżßøÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĄĆĘŁŃŚŹŻØ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyacelnszzsoAAAAAACEEEEIIIINOOOOOUUUUYACELNSZZO"
#: RFC 4122: the URL namespace for name-based identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def constant_id(x: Column) -> Column:
    """A value as a rule constant: plain lower-case letters, digits and `_`; `e_` before an empty one or a leading digit."""
    plain = F.regexp_replace(F.lower(F.translate(x, ACCENTED, PLAIN)), "[^a-z0-9_]", "_")
    return F.when((plain == "") | plain.rlike("^[0-9]"), F.concat(F.lit("e_"), plain)).otherwise(plain)


def date_token(x: Column) -> Column:
    """A date as a constant, d_YYYY_MM_DD."""
    return F.date_format(x, "'d_'yyyy'_'MM'_'dd")


def token_date(x: Column) -> Column:
    """The date of d_YYYY_MM_DD, e_YYYY_MM_DD or YYYY_MM_DD, also with a time after it; else null."""
    parts = r"^(?:[ed]_)?(\d{4})_(\d{2})_(\d{2})(?:_\d{2}_\d{2}(?:_\d{2})?)?$"
    day = F.when(x.rlike(parts), F.regexp_replace(x, parts, "$1-$2-$3"))
    return F.try_to_date(day, "yyyy-MM-dd")


def token_number(x: Column) -> Column:
    """The number of e_199_99 (199.99): the last group is the fraction, other `_` group digits; a single group is whole."""
    digits = F.regexp_replace(x, "^e_", "")
    ok = digits.rlike(r"^\d+(_\d+)*$")
    whole = F.regexp_replace(F.regexp_replace(digits, r"_\d+$", ""), "_", "")
    split = F.concat(whole, F.lit("."), F.regexp_extract(digits, r"_(\d+)$", 1))
    return F.when(ok, F.when(F.contains(digits, F.lit("_")), split).otherwise(digits)).try_cast("double")


def args_of(atom: Column) -> Column:
    """The arguments of `pred(a, b)` as an array, trimmed."""
    return F.transform(F.split(F.regexp_extract(atom, r"^\s*\w+\((.*)\)\s*\.?\s*$", 1), ","), lambda a: F.trim(a))


def predicate_of(atom: Column) -> Column:
    return F.lower(F.regexp_extract(atom, r"^\s*(\w+)\(", 1))


def atom_key(predicate: Column, roles: dict[str, Column]) -> Column:
    """pred(ROLE=value,...) with roles in order: the identity of a ground atom."""
    parts = [F.concat(F.lit(f"{r}="), roles[r].cast("string")) for r in sorted(roles)]
    return F.concat(predicate, F.lit("("), F.concat_ws(",", *parts), F.lit(")"))


def fact_key(predicate: Column, args: Column) -> Column:
    """PRED|ROLE=entity|ROLE=$literal with arguments sorted; args: array of struct(role, entity_id, literal_value)."""
    text = F.transform(args, lambda a: F.concat(a["role"], F.lit("="), F.coalesce(a["entity_id"], F.concat(F.lit("$"), a["literal_value"]))))
    return F.concat_ws("|", predicate, F.array_sort(text))


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stable_time(name: Column, year: int) -> Column:
    """A timestamp in a year that depends on the name alone."""
    seconds = F.conv(F.substring(F.sha2(name, 256), 1, 10), 16, 10).cast("long") % (365 * 86400)
    return F.timestamp_add("SECOND", seconds, F.lit(f"{year}-01-01 00:00:00").cast("timestamp"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def top_and_margin(logits: Column) -> tuple[Column, Column]:
    """Largest probability and its lead over the second; a single value leads by 1."""
    p = F.sort_array(softmax(logits), asc=False)
    return F.get(p, F.lit(0)), F.get(p, F.lit(0)) - F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))


def logit_margin(logits: Column) -> Column:
    """Lead of the largest logit; infinite for one value, null for none."""
    s = F.sort_array(logits, asc=False)
    return F.when(F.size(logits) == 1, F.lit(float("inf"))).otherwise(F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def argmax_value(logits: Column, domain: Column) -> Column:
    """The value with the largest logit; ties go to the first."""
    return F.get(domain, (F.array_position(logits, F.array_max(logits)) - 1).cast("int"))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def entropy(p: Column, floor: float = 1e-9) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(F.greatest(x, F.lit(floor))))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def span_text(content: Column, start: Column, end: Column) -> Column:
    """content[start:end], trimmed; null if empty or out of range."""
    cut = F.trim(F.substring(content, start + 1, F.greatest(end - start, F.lit(0))))
    return F.when((start >= 0) & (cut != ""), cut)


def excerpt(text: Column, most: int) -> Column:
    """White space collapsed; cut to `most` characters with `...` at the end."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(most - 3))), F.lit("...")))


def type_of_id(entity_id: Column, prefixes: dict[str, str], otherwise: str) -> Column:
    """Entity type by the prefix of its id."""
    out = F.lit(otherwise)
    for prefix in sorted(prefixes, reverse=True):
        out = F.when(F.startswith(entity_id, F.lit(prefix)), F.lit(prefixes[prefix])).otherwise(out)
    return out


def object_or_null(x: Column, schema: str) -> Column:
    """JSON text as a struct; null if it is no object."""
    return F.when(F.trim(x).rlike(r"^\{"), F.from_json(x, schema))


def label(x: Column) -> Column:
    """A constant for people: d_2026_03_03 becomes 2026-03-03, other `_` become blanks."""
    return F.when(x.rlike(r"^d_\d{4}_\d{2}_\d{2}$"), F.regexp_replace(F.substring(x, 3, 10), "_", "-")).otherwise(F.regexp_replace(x, "_", " "))


def relation_name(predicate: Column, role: Column) -> Column:
    return F.concat(F.lit("supports:"), F.lower(predicate), F.lit(":"), F.upper(role))


def relation_parts(relation: Column) -> tuple[Column, Column]:
    pattern = r"^supports:([^:]+):([^:]+)$"
    return F.nullif(F.regexp_extract(relation, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(relation, pattern, 2), F.lit(""))
