"""JSON in: API payloads with unknown layout, and cards embedded in pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideboard.functions import posting as X
from tideboard.functions import text as T
from tideboard.functions.verdicts import is_job_title
from tideboard.rules import lexicons as L
from tideboard.rules import pages as R
from tideboard.schema import CARD_SCHEMA

CARD_KEY = "hydrateJobCardsResponse"
CARDS_TYPE = f"struct<jobCards: array<{CARD_SCHEMA}>>"


# --- API payloads --------------------------------------------------------------------------

def explode_payloads(df: DataFrame, json_col: str = "payload", keep_unparsable: bool = False) -> DataFrame:
    """One row per JSON object of a payload: the root list, else the lists under the known keys,
    in key order. Adds list_key, pos and item; other values in a list are skipped. The payload is
    parsed once. ``keep_unparsable`` keeps bad payloads as one row with a NULL item and an error."""
    kept = [c for c in df.columns if c != json_col]
    doc = F.col("_doc")
    variant_list = "array<variant>"

    def entries_under(key: str, path: str) -> Column:
        items = F.coalesce(F.try_variant_get(doc, path, variant_list), F.array().cast(variant_list))
        return F.transform(
            items,
            lambda item, i: F.struct(F.lit(key).alias("list_key"), i.cast("bigint").alias("pos"), item.alias("item")),
        )

    lists = [("", "$")] + [(key, f"$.{key}") for key in R.PAYLOAD_LISTS]
    entries = F.flatten(F.array(*[entries_under(key, path) for key, path in lists]))
    parsed = df.select(*kept, F.try_parse_json(F.col(json_col)).alias("_doc"))
    rows = (
        T.explode_once(parsed, kept, entries, "_i", "e")
        .select(*kept, "e.list_key", "e.pos", "e.item")
        .filter(F.startswith(F.schema_of_variant(F.col("item")), F.lit("OBJECT")))
    )
    if not keep_unparsable:
        return rows
    bad = parsed.filter(doc.isNull()).select(*kept, F.lit("payload is not JSON").alias("error"))
    return rows.unionByName(bad, allowMissingColumns=True)


def _first_present(item: Column, keys) -> Column:
    """Value under the first key that is present, even when it is JSON null."""
    return F.coalesce(*[F.try_variant_get(item, f"$.{k}", "variant") for k in keys])


def _as_text(value: Column) -> Column:
    """Lists of values are joined with a comma; everything else is its own text."""
    as_list = F.try_variant_get(value, "$", "array<variant>")
    joined = F.array_join(F.transform(as_list, lambda v: F.try_variant_get(v, "$", "string")), ", ")
    return T.blank_to_null(F.coalesce(joined, F.try_variant_get(value, "$", "string")))


def project_payload(items: DataFrame, company: Column | None = None) -> DataFrame:
    """Posting columns of exploded payload items. Items without a valid title are dropped."""
    kept = [c for c in items.columns if c not in ("item", "list_key", "error")]
    value = {field: _first_present(F.col("item"), keys) for field, keys in R.PAYLOAD_KEYS.items()}
    text = {field: F.try_variant_get(v, "$", "string") for field, v in value.items()}
    pay = value["salary_range"]
    is_object = F.startswith(F.schema_of_variant(pay), F.lit("OBJECT"))
    pay_range = F.concat(
        F.coalesce(F.try_variant_get(pay, "$.min", "string"), F.lit("")),
        F.lit(" - "),
        F.coalesce(F.try_variant_get(pay, "$.max", "string"), F.lit("")),
    )
    return (
        items.select(
            *kept,
            text["title"].alias("raw_title"),
            T.clean_text(text["title"]).alias("title"),
            (company if company is not None else F.lit(None).cast("string")).alias("company"),
            T.blank_to_null(T.clean_text(_as_text(value["location"]))).alias("location"),
            T.blank_to_null(T.clean_text(text["description"])).alias("description"),
            text["url"].alias("url"),
            text["employment_type"].alias("employment_type"),
            F.when(is_object, pay_range).otherwise(T.blank_to_null(text["salary_range"])).alias("salary_range"),
            text["posted_date"].alias("posted_date"),
        )
        .filter(is_job_title(F.col("raw_title")))
        .drop("raw_title")
    )


# --- cards embedded in pages ---------------------------------------------------------------

def explode_embedded_json(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per card: page_id, the page columns to keep, pos, card. The first JSON script with the card list wins; without
    one, the object behind the key in any script is read. Pages without the key never reach a
    pattern: the plain test is pushed to the scan."""
    html = F.col("html")
    json_script = r"(?is)<script\b[^>]*type=[\"']application/json[\"'][^>]*>(.*?)</script\s*>"
    bodies = F.filter(
        F.regexp_extract_all(html, F.lit(json_script), F.lit(1)), lambda s: F.contains(s, F.lit(CARD_KEY))
    )
    in_json = F.get(
        F.filter(
            F.transform(bodies, lambda s: F.from_json(s, f"struct<{CARD_KEY}: {CARDS_TYPE}>")[CARD_KEY]["jobCards"]),
            lambda cards: cards.isNotNull(),
        ),
        0,
    )
    any_script = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1)),
        lambda s: F.contains(s, F.lit(f'"{CARD_KEY}"')),
    )
    behind_key = F.get(
        F.filter(
            F.transform(
                any_script,
                lambda s: F.from_json(
                    F.regexp_extract(s, rf'(?s)"{CARD_KEY}"[^{{]*(\{{.*)', 1), CARDS_TYPE
                )["jobCards"],
            ),
            lambda cards: cards.isNotNull(),
        ),
        0,
    )
    with_key = pages.filter(F.contains(html, F.lit(CARD_KEY)))
    return T.explode_once(with_key, ["page_id", *keep], F.coalesce(in_json, behind_key), "pos", "card")


def _code_map(codes: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def _code_name(values: Column, codes: dict[int, str], default: str) -> Column:
    """Name of the first code; unknown codes get the default, no code stays NULL."""
    code = F.get(values, 0)["name"]
    name = F.coalesce(F.try_element_at(_code_map(codes), code), F.lit(default))
    return F.when(F.size(values) > 0, name)


def project_board_cards(cards: DataFrame, base_url: str = "") -> DataFrame:
    """The 18 posting fields of embedded cards. Cards without title are dropped."""
    card = F.col("card")

    def link(c: Column) -> Column:
        return F.when(T.blank_to_null(c).isNull() | F.startswith(c, F.lit("http")), c).otherwise(
            F.concat(F.lit(base_url), c)
        )

    low, high = card["pay"]["min"], card["pay"]["max"]
    pay = F.concat(F.lit("$"), F.format_number(low, 0), F.lit(" - $"), F.format_number(high, 0))
    posted = card["status"]["postedAtUtc"]
    iso_day = F.when(
        F.try_to_timestamp(F.regexp_replace(posted, "Z$", "+00:00")).isNotNull(),
        T.blank_to_null(F.regexp_extract(posted, r"^\d{4}-\d{2}-\d{2}", 0)),
    )
    benefit_names = F.transform(
        F.filter(card["benefits"], lambda b: F.map_contains_key(_code_map(L.CARD_BENEFITS), b["name"])),
        lambda b: F.try_element_at(_code_map(L.CARD_BENEFITS), b["name"]),
    )
    skills = X.terms_in(card["shortDescription"], L.CARD_SKILLS)
    none = F.lit(None)
    return cards.filter(F.coalesce(card["title"], F.lit("")) != "").select(
        *[c for c in cards.columns if c != "card"],
        card["title"].alias("title"),
        card["company"]["name"].alias("company"),
        link(card["companyUrl"]).alias("company_url"),
        card["location"]["displayName"].alias("location"),
        card["shortDescription"].alias("description"),
        link(card["jobRedirectPageUrl"]).alias("url"),
        F.when((low != 0) & (high != 0), pay).alias("salary_range"),
        none.cast("string").alias("job_type"),
        F.coalesce(iso_day, posted).alias("posted_date"),
        X.experience_level(card["title"]).alias("experience_level"),
        F.when(F.size(benefit_names) > 0, benefit_names).alias("benefits"),
        none.cast("array<string>").alias("requirements"),
        F.when(F.size(skills) > 0, skills).alias("skills"),
        _code_name(card["locationTypes"], L.CARD_WORK_MODES, L.CARD_WORK_MODE_DEFAULT).alias("remote_type"),
        _code_name(card["employmentTypes"], L.CARD_EMPLOYMENT, L.CARD_EMPLOYMENT_DEFAULT).alias("employment_type"),
        none.cast("string").alias("industry"),
        none.cast("string").alias("company_size"),
        card["listingKey"].alias("job_id"),
    )
