"""Language tags: normal form and the label that a prompt uses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions.text import trim

#: Labels by lower-case tag, then by language with a star for any region.
LABELS = {
    "en": "English",
    "en-us": "English (US)",
    "en-gb": "English (UK)",
    "es": "Spanish (Neutral)",
    "spa": "Spanish (Neutral)",
    "es-es": "Spanish (Spain)",
    "ea": "Spanish (Neutral Latin American)",
    "spl": "Spanish (Neutral Latin American)",
    "en-*": "English",
    "es-*": "Spanish (Neutral Latin American)",
}


def language_tag(c: Column) -> Column:
    """Underscores to dashes, runs of dashes to one; language in lower case, a two-letter region in upper case."""
    parts = F.split(F.regexp_replace(F.replace(trim(c), F.lit("_"), F.lit("-")), "-{2,}", "-"), "-", -1)
    region = F.get(parts, F.lit(1))
    region = F.when(F.octet_length(region) == 2, F.upper(region)).when(F.octet_length(region) == 3, F.lower(region)).otherwise(region)
    rest = F.when(F.size(parts) >= 3, F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.when(F.size(parts) >= 2, F.concat(F.array(F.lower(F.get(parts, F.lit(0))), region), rest)).otherwise(F.array(F.lower(F.get(parts, F.lit(0))))), "-")


def language_label(c: Column) -> Column:
    """The label of the tag, else of its language, else the tag itself."""
    tag = language_tag(c)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABELS.items())])
    wild = F.when(F.instr(tag, "-") > 0, F.concat(F.split(tag, "-", 2)[0], F.lit("-*")))
    return F.coalesce(F.try_element_at(known, F.lower(tag)), F.try_element_at(known, wild), tag)
