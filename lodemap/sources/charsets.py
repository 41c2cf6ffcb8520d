"""Which encoding the bytes of text files are in: every candidate reads every line, and the likeliest reading wins.

Tasks decode the lines that hold a byte beyond ASCII with each candidate and add up
what comes out: errors, letters that the encoding's languages use, and signs that
text seldom has.  One row a candidate meets on the driver, whatever the files' size.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings that are told apart, in the order in which ties are kept, and letters that their texts are made of.
LETTERS = {
    "utf-8": "",
    "windows-1252": "éèàçêëîïôûùüöäßñáíóúãõåæøâœÉÈÀÇÜÖÄÑÁÍÓÚÅÆØ€£°§«»’“”–…",
    "windows-1250": "ąćęłńóśźżčďěňřšťůžýáéíőűăâîşţđĄĆĘŁŃÓŚŹŻČŘŠŽŐŰ„”",
    "windows-1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїєґОЕАИНТСРВЛКМДПУЯЫЬГЗБЧЙХЖШЮЦЩЭФЁ«»—№",
    "koi8-r": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёОЕАИНТСРВЛКМДПУЯЫЬГЗБЧЙХЖШЮЦЩЭФ",
    "windows-1253": "αοιετσνηυρπκμλωδγχθφβξζψςάέήίόύώΑΟΙΕΤΣΝΗΥΡΠΚΜΛΩΔΓΧΘΦΒ",
    "windows-1254": "ıişğüöçİŞĞÜÖÇâî",
    "shift_jis": "",
    "euc-jp": "",
    "gb18030": "",
    "big5": "",
    "euc-kr": "",
}
#: Ranges of characters that texts of the encodings with several bytes are mostly made of.
RANGES = {
    "shift_jis": ((0x3040, 0x30FF), (0x4E00, 0x9FFF)), "euc-jp": ((0x3040, 0x30FF), (0x4E00, 0x9FFF)), "gb18030": ((0x4E00, 0x9FFF),), "big5": ((0x4E00, 0x9FFF),), "euc-kr": ((0xAC00, 0xD7A3),),
}
# Frequent characters by which Chinese and Japanese readings are told from chance.
FREQUENT = {
    "gb18030": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高",
    "big5": "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作里用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實日軍者意無力它與長把機十民第公此已工使情明性知全三又關點正業外將兩高",
    "shift_jis": "のにはをたがでてとしれさいるなもっりんあかくらこまうせすけきおよそ日本人一大国年中",
    "euc-jp": "のにはをたがでてとしれさいるなもっりんあかくらこまうせすけきおよそ日本人一大国年中",
    "euc-kr": "이다는의에을가고한하지은로를사기도어아리자서시나대정인일스그해수보제라부",
}
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
SCHEMA = "encoding string, errors long, likely double, unlikely long, beyond long"


def judged(line: bytes, encoding: str) -> tuple[int, float, int, int]:
    """(errors, likely, unlikely, characters beyond ASCII) of a line in one reading."""
    try:
        text = line.decode(encoding)
    except UnicodeDecodeError:
        return 1, 0.0, 0, 0
    letters, ranges, frequent = LETTERS[encoding], RANGES.get(encoding, ()), FREQUENT.get(encoding, "")
    likely, unlikely, beyond, small = 0.0, 0, 0, False
    for ch in text:
        if ch < "\x80":
            small = ch.islower()
            continue
        beyond += 1
        if ch < "\xa0" or "─" <= ch <= "◿" or "" <= ch <= "" or small and ch.isupper():
            unlikely += 1  # control signs, boxes, private use, a capital after a small letter
        elif frequent:
            likely += 1.0 if ch in frequent else 0.3 * any(a <= ord(ch) <= b for a, b in ranges)
        else:
            likely += encoding == "utf-8" or ch in letters
        small = ch.islower()
    return 0, likely, unlikely, beyond


def readings(lines: DataFrame) -> DataFrame:
    """(encoding, errors, likely, unlikely, beyond) over all lines of (value binary) that hold a byte beyond ASCII."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {e: [0, 0.0, 0, 0] for e in LETTERS}
        for batch in batches:
            for line in batch["value"]:
                for e, s in sums.items():
                    for k, x in enumerate(judged(bytes(line), e)):
                        s[k] += x
        yield pd.DataFrame([(e, *s) for e, s in sums.items()], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    beyond = lines.where(F.hex("value").rlike("^(..)*[89A-F]"))
    out = beyond.select("value").mapInPandas(run, SCHEMA)
    return out.groupBy("encoding").agg(*[F.sum(c).alias(c) for c in ("errors", "likely", "unlikely", "beyond")])


def detected(spark: SparkSession, path: str) -> tuple[str, float]:
    """(encoding, confidence) of text files: their mark, UTF-8 if all lines are, else the likeliest reading without errors.

    Files of ASCII alone are UTF-8.  The confidence is the share of likely characters less that of unlikely ones.
    """
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("value"))
    starts = lines.select(F.substring("value", 1, 4).alias("start")).where(F.hex("start").rlike("^(EFBBBF|FFFE|FEFF)")).limit(1).collect()
    if starts:
        return next(name for mark, name in MARKS if bytes(starts[0]["start"]).startswith(mark)), 1.0
    rows = {r["encoding"]: r for r in readings(lines).collect()}  # a row for each candidate
    if not rows or not rows["utf-8"]["errors"]:
        return "utf-8", 1.0
    able = [(r["likely"] - r["unlikely"]) / r["beyond"] if not r["errors"] and r["beyond"] else -1.0 for r in (rows[e] for e in LETTERS)]
    best = max(range(len(able)), key=able.__getitem__)
    if able[best] < 0.2:
        return "windows-1252", 0.2
    return list(LETTERS)[best], round(min(0.99, able[best]), 4)
