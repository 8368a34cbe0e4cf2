"""Label text to ingredient rows, in array form: no window, no shuffle."""

from __future__ import annotations

from string import digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.exprs import AFTER, BEGUN, LOWER, PERCENT, SPACES, WORD, bound, by_first_letter, only_with, plain_spaces
from larder.functions.tables import spread

#: What the reference keeps of a product's label.
MAX_INGREDIENTS = 81
#: Phrases of panel, contact and storage lines.
NOISE = (
    "daily value|per serving|per container|serving size|servings|amount per|nutrition facts|calories|total fat|saturated fat|trans fat|polyunsaturated fat|"
    "monounsaturated fat|total carbohydrate|dietary fiber|total sugars|added sugars|cholesterol|distributed by|manufactured|net wt|net weight|fl oz|best before|"
    "best by|use by|sell by|exp date|questions|comments|satisfaction|refrigerat|produced in|made in|product of|packaged|facility|contains less than|may contain|www|http"
)
#: Units of nutrition values.
PANEL_UNITS = "mg|mcg|g|kg|kcal|iu|ml|oz"
#: Stands in what is no ingredient; normalised text has no such sign.
NO_INGREDIENT = "#"
# Few characters stand between words of normalised text; a phrase is looked for behind them
# only, and by its first letter.
_NO_INGREDIENT = rf"[ ,&'-](?=[{digits}{''.join(sorted({p[0] for p in NOISE.split('|')}))}])(?:{by_first_letter(NOISE)}|[0-9]++ ?(?:{PANEL_UNITS}))(?![{LOWER}])"
_HOST = f"{WORD}.-"
_ENDING = rf"\.(?:com|net|org|co|us){AFTER}"
#: Both begin where a run of their characters does, so a run is read once: an address takes
#: its whole run, a domain what stands before its run's last ending.
ADDRESS = r"(?<!\S)\S[^\s@]*+@\S\S*\.\S+"
DOMAIN = rf"(?i)(?<![{_HOST}])([.-]*+)[{WORD}][{_HOST}]*{_ENDING}"


def clean_label(text: Column) -> Column:
    """Text with addresses, heading and brackets replaced; commas separate ingredients."""
    t = plain_spaces(text)
    # Most labels have neither sign, without which no link and no domain is found.
    linked = bound(t, lambda x: F.when(F.contains(x, F.lit(".")) | F.contains(x, F.lit("://")), _without_links(x)).otherwise(x))
    t = F.regexp_replace(linked, r"(?is)^(.*?)ingredients?:?", "$1 ")
    t = F.regexp_replace(t, "(?i)contains( 2% or less of| less than 2% of)?:?", ",")
    t = F.regexp_replace(t, r"[\[\]{}]", ",")
    return F.regexp_replace(t, f"(?i)a{BEGUN}nd{AFTER}", ",")


def _without_links(t: Column) -> Column:
    t = F.regexp_replace(t, rf"(?i)[hw]{BEGUN}(?:(?<=h)ttps?://|(?<=w)ww\.)\S+", " ")
    t = only_with(t, "@", ADDRESS, " ")
    return F.when(t.rlike(f"(?i){_ENDING}"), F.regexp_replace(t, DOMAIN, "$1 ")).otherwise(t)


def raw_text(cleaned: Column) -> Column:
    """A cleaned label with a comma before each ingredient, without brackets and double spaces."""
    t = F.regexp_replace(F.concat(F.lit(","), cleaned), "[,;.][,;.]++|[;.]", ",")
    t = only_with(t, "(", r"\([^),]*+\)|(\([^),]*+)", "$1")
    return F.regexp_replace(t, SPACES, " ")


def norm_text(raw: Column) -> Column:
    """What ``norm`` gives of each ingredient of ``raw_text``, told by few passes over the whole
    label; the same commas stand before them, and NO_INGREDIENT in what is none."""
    t = only_with(F.lower(raw), "%", PERCENT, " ")
    t = F.regexp_replace(t, rf"[^{LOWER}&'\-, ]+", " ")
    return F.regexp_replace(only_with(t, "  ", "  ++", " "), _NO_INGREDIENT, f"$0{NO_INGREDIENT}")


def ingredient_array(text: Column, most: int | None = MAX_INGREDIENTS) -> Column:
    """``array<struct<raw, norm>>`` in label order, the first ``most`` or all."""
    return bound(raw_text(clean_label(text)), lambda raw: _ingredients(raw, norm_text(raw), most))


def _ingredients(raw: Column, normal: Column, most: int | None) -> Column:
    pairs = F.zip_with(F.split(raw, ","), F.split(normal, ","), lambda r, n: F.struct(F.trim(r).alias("raw"), F.trim(n).alias("norm")))
    kept = F.filter(pairs, lambda x: (F.length(x["norm"]) >= 2) & ~F.contains(x["norm"], F.lit(NO_INGREDIENT)))
    fresh = bound(kept, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["norm"] != F.get(a, i - 1)["norm"])))
    return fresh if most is None else F.slice(fresh, 1, most)


def parse_labels(labels: DataFrame, id_col: str = "product_id", text_col: str = "ingredients_text", *keep: str, most: int | None = MAX_INGREDIENTS) -> DataFrame:
    """``(id, *keep, pos, raw, norm)``; a label without ingredients has no row, and of longer
    ones the first ``most`` are kept. ``None`` keeps all, for texts that are no product's label.

    Labels are spread, since parsing takes far longer than reading. Texts are cleaned in a
    projection of their own: within array functions a step would run anew at each mention.
    Ingredients are normalised together, as one text, before they are told apart.
    """
    texts = spread(labels.select(id_col, *keep, F.col(text_col).alias("_text")), id_col, "_text")
    texts = texts.select(id_col, *keep, clean_label(F.col("_text")).alias("_cleaned"))
    texts = texts.select(id_col, *keep, raw_text(F.col("_cleaned")).alias("_raw"))
    texts = texts.select(id_col, *keep, "_raw", norm_text(F.col("_raw")).alias("_norm"))
    rows = texts.select(id_col, *keep, F.posexplode(_ingredients(F.col("_raw"), F.col("_norm"), most)).alias("pos", "_x"))
    return rows.select(id_col, *keep, "pos", "_x.raw", "_x.norm")
