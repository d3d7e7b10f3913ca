"""Columns that follow from the musical elements of a candidate: colour, name and rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, CueConfig
from .text import sanitize_xml_text

#: Melodic elements, for colours and (without bass) for the rank of loops.
MELODY = ("piano", "synth", "strings", "guitar", "bass")
RANKED_MELODY = ("piano", "synth", "strings", "guitar")
#: What a vocal's name is joined with, and the names of single elements, in order of precedence.
WITH_VOCALS = ("synth", "piano", "drums", "guitar", "strings", "bass")
SINGLE = ("piano", "synth", "strings", "guitar", "drums", "bass")


def known(elements: Column) -> Column:
    return F.coalesce(elements, F.array().cast("array<string>"))


def _has(elements: Column, *names: str) -> Column:
    el = known(elements)
    found = F.array_contains(el, names[0]) if len(names) == 1 else F.arrays_overlap(el, F.array(*map(F.lit, names)))
    return F.coalesce(found, F.lit(False))


def has_elements(elements: Column) -> Column:
    return F.size(known(elements)) > 0


def classify_color(elements: Column) -> Column:
    """One of five colours; what the analysis proposed has no say."""
    drums, vocals = _has(elements, "drums"), _has(elements, "vocals")
    only_drums = F.size(F.array_except(known(elements), F.array(F.lit("drums"), F.lit("percussion")))) == 0
    lone_percussion = _has(elements, "percussion") & (F.size(known(elements)) == 1)
    return (
        F.when(vocals & drums, "yellow").when(drums & only_drums, "purple").when(drums, "green").when(vocals, "orange")
        .when(_has(elements, *MELODY), "blue").when(lone_percussion, "purple").otherwise("blue")
    )


def color_correction(elements: Column, proposed: Column, cfg: CueConfig = DEFAULT) -> Column:
    """Struct (corrected, reason): whether the colour differs from the proposal, and why purple became blue."""
    was, color = F.coalesce(proposed, F.lit(cfg.default_color)), classify_color(elements)
    reason = F.when((was == "purple") & (color == "blue"), F.lit("melodic elements without drums"))
    return F.struct((color != was).alias("corrected"), reason.alias("reason"))


def encode_color(name: Column, cfg: CueConfig = DEFAULT) -> Column:
    codes = F.create_map(*(F.lit(x) for pair in cfg.colors.items() for x in pair))
    return F.coalesce(F.try_element_at(codes, name), F.lit(cfg.colors[cfg.default_color]))


def decode_color(code: Column, cfg: CueConfig = DEFAULT) -> Column:
    names = F.create_map(*(F.lit(x) for name, code in cfg.colors.items() for x in (code, name)))
    return F.try_element_at(names, code)


def cue_base_name(elements: Column, number: Column) -> Column:
    """The name that elements give: vocals with the first of their companions, known pairs and singles, else the first
    two in code-point order, else mix and a number."""
    el = known(elements)
    ordered = F.array_sort(el)
    name = F.when(_has(el, "vocals"), F.coalesce(*(F.when(_has(el, e), f"vocal{e}") for e in WITH_VOCALS), F.lit("vocals")))
    name = name.when(_has(el, "piano") & _has(el, "synth"), "pianosynth").when(_has(el, "drums") & _has(el, "bass"), "drumsBass")
    for e in SINGLE:
        name = name.when(_has(el, e), e)
    return name.when(F.size(el) > 0, F.array_join(F.slice(ordered, 1, 2), "")).otherwise(F.concat(F.lit("mix"), number.cast("string")))


def _given(name: Column) -> Column:
    return F.nullif(name, F.lit(""))


def cue_name(given: Column, elements: Column, number: Column) -> Column:
    return sanitize_xml_text(F.coalesce(_given(given), cue_base_name(elements, number)))


def raw_loop_name(given: Column, elements: Column) -> Column:
    """A loop's name ends with `l`; a name made from elements that starts with `mix` is `loopl`."""
    base = cue_base_name(elements, F.lit(0))
    made = F.when(F.startswith(base, F.lit("mix")), "loopl").otherwise(F.concat(base, F.lit("l")))
    name = F.coalesce(_given(given), made)
    return F.when(F.endswith(name, F.lit("l")), name).otherwise(F.concat(name, F.lit("l")))


def loop_name(given: Column, elements: Column) -> Column:
    return sanitize_xml_text(raw_loop_name(given, elements))


def loop_priority(elements: Column, policy: str = "batch") -> Column:
    """0 drums without vocals, two elements at most; 1 vocals; 2 melody alone; 3 the rest. The policy `single` splits
    the rest into two elements at most (3) and more (4)."""
    drums, vocals, few = _has(elements, "drums", "percussion"), _has(elements, "vocals"), F.size(known(elements)) <= 2
    rank = F.when(drums & ~vocals & few, 0).when(vocals, 1).when(_has(elements, *RANKED_MELODY) & ~drums, 2)
    return rank.otherwise(3) if policy == "batch" else rank.when(few, 3).otherwise(4)
