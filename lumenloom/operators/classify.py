"""Keyword, dimension and nearest-centroid classification on the three-axis taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text as T

# Keywords of the style and camera codes, tried in this order.
STYLE_KEYWORDS = {
    "T2": ["oil painting", "watercolor", "watercolour", "acrylic", "ink wash", "charcoal", "pencil drawing", "sketch", "pastel", "gouache", "impressionist", "baroque", "renaissance", "ukiyo-e", "fresco", "etching", "lithograph", "woodcut", "calligraphy"],
    "T3": ["digital art", "digital illustration", "vector", "pixel art", "anime", "manga", "cartoon", "comic", "cel shaded", "flat design", "concept art", "artstation", "deviantart"],
    "T4": ["3d render", "3d rendering", "cgi", "blender", "unreal engine", "octane render", "isometric", "voxel", "low poly", "clay render"],
    "T5": ["cinematic", "film still", "movie scene", "anamorphic", "film grain", "35mm", "70mm", "imax", "technicolor", "noir", "film noir"],
    "T6": ["graphic design", "poster", "logo", "infographic", "typography", "minimal", "flat", "icon", "badge", "emblem", "sticker"],
    "T7": ["mixed media", "collage", "surreal", "glitch", "vaporwave", "psychedelic", "abstract", "experimental", "generative", "fractal", "kaleidoscope"],
}
CAMERA_KEYWORDS = {
    "C2": ["macro", "close-up", "closeup", "close up", "extreme close", "detail shot", "micro"],
    "C3": ["wide angle", "wide-angle", "panoramic", "panorama", "ultra wide", "fisheye", "fish-eye"],
    "C4": ["aerial", "bird's eye", "birds eye", "bird-eye", "drone", "satellite", "overhead", "top-down", "top down"],
    "C5": ["low angle", "low-angle", "worm's eye", "worms eye", "worm-eye", "looking up", "from below"],
    "C6": ["bokeh", "shallow depth of field", "shallow dof", "blurred background", "portrait lens", "85mm", "f/1.4", "f/1.8", "f1.4", "f1.8"],
    "C7": ["long exposure", "motion blur", "light trails", "light painting", "slow shutter", "silk water", "milky water"],
    "C8": ["dramatic lighting", "chiaroscuro", "rim light", "rim lighting", "backlit", "backlighting", "golden hour", "blue hour", "neon light", "neon glow", "volumetric light", "god rays", "spotlight", "moody lighting", "studio lighting"],
}
# T6 keywords that alone say little, and signals that confirm T6 and T7.
WEAK_DESIGN = ["minimal", "flat", "icon", "typography", "sticker", "logo", "badge", "emblem"]
STRONG_DESIGN = ["graphic design", "logo design", "poster", "infographic", "banner design", "flyer", "brochure", "advertisement", "brand identity", "sticker design", "ui design", "mockup", "layout design", "packaging design", "slide", "presentation", "diagram", "chart", "icon design", "template", "typography design"]
STRONG_EXPERIMENTAL = ["mixed media", "collage", "glitch", "vaporwave", "psychedelic", "generative", "fractal", "kaleidoscope", "experimental", "abstract art", "surreal", "double exposure", "datamosh"]

DEFAULTS = {"subject": "S10", "style": "T1", "camera": "C1"}
MARGIN = 0.05


def style(text: Column) -> Column:
    return T.first_match(text, STYLE_KEYWORDS, DEFAULTS["style"])


def camera(text: Column) -> Column:
    return T.first_match(text, CAMERA_KEYWORDS, DEFAULTS["camera"])


def subject(text: Column, mapped: Column, rules: dict[str, list[str]]) -> Column:
    """A category's mapped code, else the first keyword rule that matches, else S10. The rules are a
    parameter: code -> keywords, in order of precedence."""
    return F.coalesce(mapped, T.first_match(text, rules, DEFAULTS["subject"]))


def rules_of(taxonomy: DataFrame, axis: str) -> dict[str, list[str]]:
    """Keyword rules from a taxonomy table (axis, code, ord, label): the words of each label, singular."""
    rows = taxonomy.where(F.col("axis") == axis).select("code", "label", "ord").orderBy("ord").collect()
    import re

    out = {}
    for r in rows:
        found = re.findall(r"[A-Z]?[a-z]{3,}", r["label"])
        out[r["code"]] = [w.lower().removesuffix("s") for w in found] or [r["label"].lower()]
    return out


def weak_design(text: Column) -> Column:
    """Every T6 keyword in the text is a weak one; so it is if there is none."""
    return F.forall(T.matched(text, STYLE_KEYWORDS["T6"]), lambda k: k.isin(*WEAK_DESIGN))


def gated(code: Column, text: Column) -> Column:
    """T6 and T7 need a strong signal in the text, else T1."""
    unsure = ((code == "T6") & ~T.any_of(text, STRONG_DESIGN)) | ((code == "T7") & ~T.any_of(text, STRONG_EXPERIMENTAL))
    return F.when(unsure, F.lit("T1")).otherwise(code)


def hybrid_subject(keyword: Column, caption_best: Column, best: Column, gap: Column) -> Column:
    """A caption's own best; else the keyword's code; else the nearest centroid if it beats S10 by the margin."""
    near = F.when((best != "S10") & (gap > MARGIN), best).otherwise("S10")
    return F.coalesce(caption_best, F.when(keyword != "S10", keyword).otherwise(near))


def hybrid_style(text: Column, keyword: Column, sentence: Column, caption_best: Column, best: Column, gap: Column) -> Column:
    """As for subjects, with the T6 and T7 gates before the margin and weak T6 keywords disregarded."""
    trusted = F.when((keyword == "T6") & weak_design(text), F.lit("T1")).otherwise(keyword)
    strong = gated(best, text)
    near = F.when((strong != "T1") & (gap > MARGIN), strong).otherwise("T1")
    return F.coalesce(F.when(caption_best.isNotNull(), gated(caption_best, sentence)), F.when(trusted != "T1", trusted).otherwise(near))


def hybrid_camera(keyword: Column, best: Column, gap: Column) -> Column:
    return F.when(keyword != "C1", keyword).otherwise(F.when((best != "C1") & (gap > MARGIN), best).otherwise("C1"))


def mapped_subject(category: Column, source: Column, by_source: dict[tuple[str, str], str], by_category: dict[str, str]) -> Column:
    """The code of a category in a source's own map, else in the common one; null if neither has it."""
    own = F.create_map(*[F.lit(x) for (s, c), code in by_source.items() for x in (f"{s}\0{c}", code)])
    common = F.create_map(*[F.lit(x) for kv in by_category.items() for x in kv])
    key = F.concat(F.coalesce(source, F.lit("")), F.lit("\0"), F.coalesce(category, F.lit("")))
    return F.coalesce(F.element_at(own, key), F.element_at(common, F.coalesce(category, F.lit(""))))


def zero_shot(rows: DataFrame, text: str, vector: str, caption_vector: str, axes: dict[str, tuple[DataFrame, str, int]], rules: dict[str, list[str]]) -> DataFrame:
    """``rows`` with subject, style and camera by the hybrid rules, in one pass over the rows.

    ``axes``: for each of the three the labels' centroids (ord, centroid), the letter of its codes and the
    ord of its default; a code is the letter and ord + 1. The caption's vector counts where the text is a
    caption. Null texts have no keyword and no caption; a null vector leaves an axis to the keywords.
    """
    from lumenloom.operators.vectors import scored

    out = rows
    for axis, (labels, letter, default) in axes.items():
        for which, column in (("best", vector), ("caption", caption_vector)):
            if axis == "camera" and which == "caption":
                continue
            out = scored(out, column, labels)
            best = F.array_max("scores")
            own = F.element_at(F.filter("scores", lambda x: x["back"] == -default), 1)["score"]  # noqa: B023
            out = out.withColumn(f"_{axis}_{which}", F.concat(F.lit(letter), (1 - best["back"]).cast("string")))
            if which == "best":
                out = out.withColumn(f"_{axis}_gap", best["score"] - own)
            out = out.drop("scores")
    t = F.coalesce(F.col(text), F.lit(""))
    sentence = T.caption_sentence(t)
    captioned = lambda axis: F.when(sentence.isNotNull(), F.col(f"_{axis}_caption"))
    near = lambda axis: (F.col(f"_{axis}_best"), F.col(f"_{axis}_gap"))
    made = {
        "subject": hybrid_subject(subject(t, F.lit(None).cast("string"), rules), captioned("subject"), *near("subject")),
        "style": hybrid_style(t, style(t), F.coalesce(sentence, F.lit("")), captioned("style"), *near("style")),
        "camera": hybrid_camera(camera(t), *near("camera")),
    }
    return out.withColumns(made).select(*rows.columns, *made)
