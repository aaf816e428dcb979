"""Scripts and languages by Unicode ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode ranges.
RANGES = {
    "han": "[一-鿿]",
    "kana": "[぀-ヿ]",
    "latin": "[A-Za-zÀ-ɏ]",
    "cyrillic": "[Ѐ-ӿ]",
    "digit": "[0-9]",
}


def script_count(text: Column, script: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(RANGES[script])).cast("long")


def detect_language(text: Column) -> Column:
    """Kana: ja; else most of Han: zh, Cyrillic: bg, Latin: en; null without any of them.

    The ranges cannot tell Latin-script languages apart, nor Japanese without kana from Chinese.
    """
    han, kana, latin, cyr = (script_count(text, s) for s in ("han", "kana", "latin", "cyrillic"))
    most = F.greatest(han, latin, cyr)
    return F.when(kana > 0, "ja").when(most == 0, None).when(han == most, "zh").when(cyr == most, "bg").otherwise("en")
