"""Folding against the compatibility decomposition of Python, over all characters."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from cantera.functions.text import fold, strip_marks


def by_hand(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in bare)).strip()


def test_fold_is_exact(spark):
    rnd = random.Random(1)
    texts = [f"a{chr(c)}b" for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    texts = ["|".join(texts[k : k + 50]) for k in range(0, len(texts), 50)]
    texts += ["ﬁnca ﬀ Ｗｉｆｉ ½ kg ㎏ №5 ⑩ … ™ 𝐀𝟗 ĳ ǆ Ⅷ", "plain ASCII", "", "é é ñ Ü", "ﬁ" * 2000]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x2000, 0x2200), rnd.randrange(0xFB00, 0xFB07), rnd.randrange(0xFF00, 0xFFF0)])) for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").repartition(4)
    got = dict(df.select("id", fold(F.col("t")).alias("f")).collect())
    wrong = [(texts[k], got[k], by_hand(texts[k])) for k in got if got[k] != by_hand(texts[k])]
    assert not wrong, wrong[0]
    assert spark.createDataFrame([("ﬁnca",)], "t string").select(strip_marks(F.col("t"))).first()[0] == "finca"
