"""Ingredient-name clean-up: strength, synonyms, salts and aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medlink.functions import fixed_values as V
from medlink.functions.patterns import unicode_bounds as ub
from medlink.functions.text import col, let, normalize_text

UNIT = "(?:" + "|".join(V.STRENGTH_UNITS) + ")"
SALT = ub(r"(?i)\b(?:" + "|".join(V.SALT_WORDS) + r")\b")


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _strip_ends(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def _paren_note(span: Column) -> Column:
    """One '(...)' span with its synonym markers turned into ' ; '."""
    inner = F.substr(span, F.lit(2), F.length(span) - 2)
    inner = F.regexp_replace(inner, r"^\s*=\s*", "")
    inner = F.regexp_replace(inner, r"(?i)^\s*EQ\s+TO\s+", "")
    inner = F.regexp_replace(inner, r"\s*=\s*", " ; ")
    inner = F.regexp_replace(inner, r"(?i)\s+OR\s+", " ; ")
    inner = _strip_ends(F.regexp_replace(inner, r"\s+", " "), " ;")
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit("("), inner, F.lit(")")))


def synonym_markers(c: Column | str) -> Column:
    text = F.regexp_replace(col(c), r"\(\s*=\s*", "(")
    text = F.regexp_replace(text, r"(?i)\(\s*EQ\s+TO\s+", "(")
    pieces = F.regexp_extract_all(text, F.lit(r"\([^()]*\)|[^()]+|[()]"), F.lit(0))
    fixed = F.transform(pieces, lambda p: F.when(p.rlike(r"^\([^()]*\)$"), _paren_note(p)).otherwise(p))
    return _squeeze(F.array_join(fixed, ""))


def strip_strength(c: Column | str) -> Column:
    """Drop concentrations, doses, lone numbers and lone units."""
    text = synonym_markers(c)
    text = F.regexp_replace(text, ub(rf"(?i)\b\d+(?:\.\d+)?\s*{UNIT}(?:\s*/\s*{UNIT})+"), " ")
    text = F.regexp_replace(text, ub(rf"(?i)\b\d+(?:\.\d+)?\s*{UNIT}\b"), " ")
    text = F.regexp_replace(text, ub(r"\b\d+(?:\.\d+)?\b"), " ")
    text = F.regexp_replace(text, ub(rf"(?i)\b{UNIT}\b"), " ")
    text = F.regexp_replace(text, r"\(\s*\)", " ")
    return _strip_ends(_squeeze(text), "+,/; ")


def strip_stereo(c: Column | str) -> Column:
    text = F.regexp_replace(col(c), r"(?i)(?<![A-Z0-9])DL\s*-\s*", "")
    text = F.regexp_replace(text, r"(?i)(?<![A-Z0-9])DL(?![A-Z0-9])", " ")
    return _strip_ends(F.regexp_replace(text, r"\s+", " "), " -")


def canonical_salt(c: Column | str) -> Column:
    text = F.regexp_replace(col(c), ub(r"(?i)\bDI\s*-?\s*HCL\b"), "2HCL")
    text = F.regexp_replace(text, ub(r"(?i)\b2\s*HCL\b"), "2HCL")
    text = F.regexp_replace(text, ub(r"(?i)\b2HCL(?:\s+(?:MONOHYDRATE|DIHYDRATE|HYDRATE))\b"), "2HCL")
    return _squeeze(text)


def flatten_salt_note(c: Column | str) -> Column:
    """'X (HCL)' becomes 'X HCL' when the note is short and names a salt."""
    text = _squeeze(col(c))
    shape = r"^([^()]+?)\s*\(([^()]+)\)\s*$"
    root = F.trim(F.regexp_extract(text, shape, 1))
    note = F.trim(F.regexp_extract(text, shape, 2))
    plain = normalize_text(note)
    usable = (
        text.rlike(shape)
        & (root != "")
        & (plain != "")
        & (F.length(plain) <= V.SALT_NOTE_MAX_CHARS)
        & F.upper(note).rlike("^[A-Z0-9 -]+$")
        & plain.rlike(SALT)
    )
    return F.when(usable, F.trim(F.concat(root, F.lit(" "), plain))).otherwise(text)


def compare_key(c: Column | str) -> Column:
    return normalize_text(canonical_salt(strip_stereo(c)))


def base_and_flat_tokens(c: Column | str) -> Column:
    """The comparison keys of one ingredient before aliases are applied."""

    def keys(text: Column) -> Column:
        root = F.trim(F.substring_index(text, "(", 1))
        base = compare_key(F.when(root != "", root).otherwise(text))
        both = lambda flat: F.when(flat != text, F.array(base, compare_key(flat))).otherwise(F.array(base))
        return let(flatten_salt_note(text), both)

    return F.array_distinct(F.filter(let(strip_strength(c), keys), lambda k: k != ""))


def alias_lookup(aliases: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Invert {canonical: [names]}; a name claimed twice is an error."""
    out: dict[str, str] = {}
    for canonical, names in (V.INGREDIENT_ALIASES if aliases is None else aliases).items():
        target = _plain_key(canonical)
        for name in (canonical, *names):
            key = _plain_key(name)
            if out.setdefault(key, target) != target:
                raise ValueError(f"alias {key!r} belongs to both {out[key]!r} and {target!r}")
    return out


def _plain_key(name: str) -> str:
    kept = "".join(ch if ch.isalnum() or ch == "_" else " " for ch in name.upper())
    return " ".join(kept.split())


def _alias_map(lookup: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(lookup.items()) for x in pair]).cast("map<string,string>")


def alias_hit(token: Column | str, lookup: dict[str, str] | None = None) -> Column:
    """The alias that applies to ``token``: the exact name, else the longest leading words that are a name.

    Works for any number of aliases that fits a plan; a table of aliases is joined by operators.curate.map_aliases.
    """
    names = _alias_map(alias_lookup() if lookup is None else lookup)
    words = F.split(col(token), " ")
    leads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    found = F.filter(leads, lambda lead: F.map_contains_key(names, lead))
    return F.get(found, F.size(found) - 1)


def alias_target(token: Column | str, lookup: dict[str, str] | None = None) -> Column:
    """The canonical name of the alias that applies, if any."""
    names = alias_lookup() if lookup is None else lookup
    return let(alias_hit(token, names), lambda hit: F.get(F.array(F.try_element_at(_alias_map(names), hit)), F.lit(0)))


def apply_alias(token: Column | str, lookup: dict[str, str] | None = None) -> Column:
    names, text = alias_lookup() if lookup is None else lookup, col(token)
    target = _alias_map(names)
    return let(
        alias_hit(token, names),
        lambda hit: F.coalesce(F.concat(F.try_element_at(target, hit), F.substr(text, F.length(hit) + 1)), text),
    )


def compare_tokens(c: Column | str, lookup: dict[str, str] | None = None) -> Column:
    """Set of keys under which two ingredient texts are the same ingredient."""
    return F.array_distinct(F.transform(base_and_flat_tokens(c), lambda k: apply_alias(k, lookup)))


def strip_trailing_dose(c: Column | str) -> Column:
    return F.regexp_replace(col(c), V.TRAILING_DOSE, "")
