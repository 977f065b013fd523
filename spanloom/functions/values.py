"""Entities, origins, colours, validators and coercions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.patterns import SPACE

# Entity types in their order, aliases, and Japanese names.
ENTITIES = ("PERSON", "LOCATION", "DATE_TIME", "PHONE_NUMBER", "INDIVIDUAL_NUMBER", "YEAR", "PROPER_NOUN", "OTHER")
ALIASES = {"address": "LOCATION"}
CONFIG_ALIASES = {"ADDRESS": "LOCATION", "PEARSON": "PERSON"}
NAMES_JA = {"PERSON": "人名", "LOCATION": "場所", "DATE_TIME": "日時", "PHONE_NUMBER": "電話番号", "INDIVIDUAL_NUMBER": "マイナンバー", "YEAR": "年号", "PROPER_NOUN": "固有名詞", "OTHER": "その他"}
ORIGIN_LABELS = {"manual": "手動", "custom": "追加"}

# Colours of annotations and highlights by entity, and of any other.
ANNOTATION_COLOURS = {"PERSON": (1.0, 0.0, 0.0), "LOCATION": (0.0, 1.0, 0.0), "DATE_TIME": (0.0, 0.0, 1.0), "PHONE_NUMBER": (1.0, 1.0, 0.0), "INDIVIDUAL_NUMBER": (1.0, 0.0, 1.0), "YEAR": (0.5, 0.0, 1.0), "PROPER_NOUN": (1.0, 0.5, 0.0)}
HIGHLIGHT_COLOURS = {"PERSON": (1.0, 0.8, 0.8), "LOCATION": (0.8, 1.0, 0.8), "DATE_TIME": (0.8, 0.8, 1.0), "PHONE_NUMBER": (1.0, 1.0, 0.8), "INDIVIDUAL_NUMBER": (1.0, 0.8, 1.0), "YEAR": (0.9, 0.8, 1.0), "PROPER_NOUN": (1.0, 0.9, 0.8)}
OTHER_ANNOTATION, OTHER_HIGHLIGHT = (0.0, 0.0, 0.0), (0.9, 0.9, 0.9)

# Colours by name.
CSS_COLOURS = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "cyan": (0, 255, 255), "magenta": (255, 0, 255),
    "yellow": (255, 255, 0), "gray": (128, 128, 128), "grey": (128, 128, 128), "orange": (255, 165, 0), "purple": (128, 0, 128), "pink": (255, 192, 203), "brown": (165, 42, 42),
    "teal": (0, 128, 128), "lime": (0, 255, 0), "navy": (0, 0, 128), "maroon": (128, 0, 0), "olive": (128, 128, 0), "silver": (192, 192, 192), "royalblue": (65, 105, 225),
}


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    out = default
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def blank(text: Column) -> Column:
    """Whether there is nothing but white space: the search ends at the first other character."""
    return ~text.rlike(rf"[^{SPACE}]")


def entity_key(name: Column) -> Column:
    """Stripped and upper-cased, aliases resolved; empty stays empty."""
    bare = stripped(name)
    return _lookup(ALIASES, F.lower(bare), F.upper(bare))


def normal_entity(name: str) -> str:
    """The same on the driver."""
    bare = (name or "").strip()
    return ALIASES.get(bare.lower(), bare.upper())


def config_entity(name: str) -> str:
    """As the configuration reads names, which forgives one more spelling."""
    bare = (name or "").strip().upper()
    return CONFIG_ALIASES.get(bare, bare)


def entity_colour(entity: Column, highlight: bool = False) -> Column:
    """(r, g, b) of an entity's annotation or highlight."""
    table, other = (HIGHLIGHT_COLOURS, OTHER_HIGHLIGHT) if highlight else (ANNOTATION_COLOURS, OTHER_ANNOTATION)
    make = lambda rgb: F.struct(*(F.lit(x).alias(n) for x, n in zip(rgb, "rgb")))
    out = make(other)
    for name, rgb in table.items():
        out = F.when(entity == name, make(rgb)).otherwise(out)
    return out


def entity_rank(entity: Column, order=ENTITIES) -> Column:
    """Place in the order; names outside it come last."""
    at = F.array_position(F.array(*map(F.lit, order)), entity)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))


def entity_name_ja(entity: Column) -> Column:
    return _lookup(NAMES_JA, entity, entity)


def resolved_entity(entity: Column, enabled: list[str]) -> Column:
    """A known entity only if enabled, else null; unknown names pass."""
    return F.when(~entity.isin(*ENTITIES) | entity.isin(*enabled), entity) if enabled else F.when(~entity.isin(*ENTITIES), entity)


def parse_entities(listed: str) -> list[str]:
    """Names of a comma-separated option; an unknown one is an error."""
    names = [normal_entity(x) for x in listed.split(",") if x.strip()]
    if wrong := [n for n in names if n not in ENTITIES]:
        raise ValueError(f"unknown entities {wrong}; allowed: {', '.join(ENTITIES)}")
    return names


def origin(manual: Column, name: Column) -> Column:
    bare = F.lower(F.coalesce(name, F.lit("")))
    return F.when(F.coalesce(manual, F.lit(False)) | (bare == "manual"), "manual").when(bare.isin("custom", "addition"), "custom").otherwise("auto")


def origin_label(manual: Column, name: Column) -> Column:
    """As shown in tables, where the old name ``addition`` counts as automatic."""
    bare = F.coalesce(name, F.lit(""))
    return F.when(F.coalesce(manual, F.lit(False)) | (bare == "manual"), ORIGIN_LABELS["manual"]).when(bare == "custom", ORIGIN_LABELS["custom"]).otherwise("自動")


def digits_only(text: Column) -> Column:
    """Decimal digits, full-width ones as ASCII."""
    return F.translate(F.regexp_replace(text, r"\P{Nd}", ""), "０１２３４５６７８９", "0123456789")


def check_digit(body: Column) -> Column:
    """Check digit of 11 digits: weights 2..7 then 2..6 from the right, modulo 11."""
    weights = F.array(*[F.lit(w) for w in (2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6)])
    figures = F.transform(F.split(F.reverse(body), ""), lambda c: c.cast("int"))
    rest = F.aggregate(F.zip_with(figures, weights, lambda d, w: d * w), F.lit(0), lambda a, x: a + x) % 11
    return F.when(rest <= 1, 0).otherwise(11 - rest)


def _uniform(digits: Column) -> Column:
    return F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) == 0


def valid_individual_number(text: Column) -> Column:
    d = digits_only(text)
    return F.coalesce(F.when((F.length(d) == 12) & ~_uniform(d), check_digit(F.substring(d, 1, 11)) == F.substring(d, 12, 1).cast("int")), F.lit(False))


def valid_phone_number(text: Column) -> Column:
    """10 or 11 digits, not all the same, of a Japanese numbering range (an approximation of the full plan by its prefixes)."""
    d = digits_only(text)
    plan = d.rlike(r"^0(?:[5789]0\d{8}|120\d{6}|800\d{7}|[1-9]\d{8})$")
    return F.coalesce(F.length(d).isin(10, 11) & ~_uniform(d) & plan, F.lit(False))


def valid_candidate(entity: Column, text: Column) -> Column:
    return F.when(entity == "PHONE_NUMBER", valid_phone_number(text)).when(entity == "INDIVIDUAL_NUMBER", valid_individual_number(text)).otherwise(F.lit(True))


def refined(entity: Column, text: Column) -> Column:
    """Names and places without digits, hyphens and white space; phone numbers as their digit and hyphen runs."""
    name = F.regexp_replace(text, r"(?U)[\d\s-]", "")
    phone = F.array_join(F.regexp_extract_all(text, F.lit(r"[0-9-]+"), F.lit(0)), "")
    return F.when(entity.isin("PERSON", "LOCATION"), name).when(entity == "PHONE_NUMBER", phone).otherwise(text)


def refined_start(text: Column, better: Column, start: Column) -> Column:
    """Start of the refined text; the old start where it isn't a part of the old text."""
    at = F.instr(text, better)
    return F.when((F.length(better) > 0) & (at > 0), start + at - 1).otherwise(start)


def colour(text: Column) -> Column:
    """(r, g, b, alpha) from #RGB, #RRGGBB, #RRGGBBAA, rgb(), rgba() without blanks inside, and the CSS names; grey 0.9 without alpha for anything else."""
    t = F.lower(stripped(text))
    two = lambda i: F.conv(F.substring(t, i, 2), 16, 10).cast("double") / 255
    one = lambda i: F.conv(F.repeat(F.substring(t, i, 1), 2), 16, 10).cast("double") / 255
    fn = r"^(?:rgb(?=\([^,]*,[^,]*,[^,]*\))|rgba(?=(?:[^,]*,){3}))\(([0-9]{1,3}),([0-9]{1,3}),([0-9]{1,3})(?:,([0-9]*\.?[0-9]+))?\)$"
    part = lambda i: F.regexp_extract(t, fn, i).try_cast("double")
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    make = lambda r, g, b, a: F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.cast("double").alias("alpha"))
    none = F.lit(None).cast("double")
    named = make(*(F.lit(x) for x in (0.9, 0.9, 0.9)), none)
    for name, rgb in CSS_COLOURS.items():
        named = F.when(t == name, make(*(F.lit(x / 255) for x in rgb), none)).otherwise(named)
    return (
        F.when(t.rlike(r"^#[0-9a-f]{3}$"), make(one(2), one(3), one(4), none))
        .when(t.rlike(r"^#[0-9a-f]{6}$"), make(two(2), two(4), two(6), none))
        .when(t.rlike(r"^#[0-9a-f]{8}$"), make(two(2), two(4), two(6), two(8)))
        .when(t.rlike(fn), make(clamp(part(1) / 255), clamp(part(2) / 255), clamp(part(3) / 255), F.when(part(4).isNotNull(), clamp(part(4)))))
        .otherwise(named)
    )


def flag(text: Column) -> Column:
    return F.lower(stripped(text)).isin("1", "true", "yes", "on")


def clamped(text: Column, low: float, high: float, default: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(text.try_cast("double"), F.lit(default))))


def annotation_text(entity: Column, word: Column, mode: str = "minimal", with_text: bool = False) -> Column:
    if mode == "silent":
        return F.lit("")
    body = entity if mode == "minimal" else F.concat(F.lit("entity_type:"), entity)
    return F.concat(body, F.lit(": "), F.substring(word, 1, 20)) if with_text else body


def highlight_content(word: Column, entity: Column) -> Column:
    return F.concat(F.lit('detect_word:"'), F.translate(word, "\n\r\t", ""), F.lit('",entity_type:"'), entity, F.lit('"'))


def parsed_content(content: Column) -> Column:
    """(detect_word, entity_type) of a highlight's content, null where absent."""
    part = lambda key: F.when(content.rlike(f'{key}:"[^"]*"'), F.regexp_extract(content, f'{key}:"([^"]*)"', 1))
    return F.struct(part("detect_word").alias("detect_word"), part("entity_type").alias("entity_type"))


def detection_id(entity: Column, text: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.to_json(F.array(entity, text, start.cast("string"), end.cast("string"))), 256)


def pdf_date(at: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"))


def is_manual(manual: Column, name: Column) -> Column:
    return F.coalesce(manual, F.lit(False)) | F.coalesce(F.lower(name) == "manual", F.lit(False))


def manual_entity(entity: Column, word: Column, page: Column, block: Column, offset: Column, end: Column | None = None) -> Column:
    """A detection made by hand: from a start and an end, or from one place as long as the word."""
    start = F.struct(page.alias("page_num"), block.alias("block_num"), offset.alias("offset"))
    last = F.struct(page.alias("page_num"), block.alias("block_num"), (offset + F.greatest(F.length(word), F.lit(1)) - 1).alias("offset"))
    return F.struct(start.alias("start"), (last if end is None else F.coalesce(end, last)).alias("end"), entity_key(entity).alias("entity"), word.alias("word"), F.lit("manual").alias("origin"), F.lit(True).alias("manual"))


def place_label(page: Column, block: Column, offset: Column) -> Column:
    return F.format_string("p%d:b%d:%d", page + 1, block + 1, offset + 1)
