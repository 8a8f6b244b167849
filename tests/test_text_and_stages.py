from pyspark.sql import functions as F

from loomline.functions import stages, text
from loomline.functions.stages import DEFAULT_STAGES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_bullet_pages(spark):
    for line, want in {"[PAGE 9, 8, 9] x [PAGE 3]": [8, 9], "no marker": [], "[page 3] x": [], "[PAGE7] x": [], "[PAGE ,] x": []}.items():
        assert one(spark, text.bullet_pages(F.lit(line))) == want


def test_sanitize(spark):
    for given, limit, want in [("a\x00b", 12000, "a b"), ("a  \t b", 12000, "a b"), ("a\n\n\n\nb", 12000, "a\n\nb"), ("abcdef", 3, "abc"), ("ab   cd", 3, "ab")]:
        assert one(spark, text.sanitize(F.lit(given), limit)) == want


def test_page_labels(spark):
    for pages, want in [([], "n/a"), ([3], "p. 3"), ([3, 4, 9], "pp. 3-9")]:
        assert one(spark, text.page_label(F.array(*map(F.lit, pages)).cast("array<int>"))) == want


def test_titles_and_ids(spark):
    assert one(spark, text.title_of(F.lit("/a/b/my_old_book.pdf"))) == "My Old Book"
    assert one(spark, text.title_of(F.lit("o'neil_2nd.txt"))) == "O'Neil 2Nd"
    assert one(spark, text.is_pdf(F.lit("x.PdF"))) and not one(spark, text.is_pdf(F.lit("x.txt")))
    assert one(spark, text.content_id(F.lit(b"abc"))) == "doc_a9993e364706816a"


def normalized(spark, given):
    tax = F.array(*(stages.stage(F.lit(n), F.lit(""), F.lit(f)) for n, f in given)) if given else F.array().cast(f"array<{stages.STAGE}>")
    return [(s.name, s.is_framing) for s in one(spark, stages.normalize(tax))]


def test_normalize(spark):
    assert normalized(spark, [(" A ", False)]) == [("A", False), *((n, i == 3) for i, n in enumerate(DEFAULT_STAGES[:4]))]
    assert normalized(spark, []) == [(n, i == 4) for i, n in enumerate(DEFAULT_STAGES)]
    assert normalized(spark, [(str(i), i == 7) for i in range(8)]) == [(str(i), i == 6) for i in range(7)]
    assert normalized(spark, [("", False), *((c, c == "C") for c in "ABCDE")]) == [(c, c == "C") for c in "ABCDE"]


def test_stage_index(spark):
    names = F.array(*map(F.lit, ("Shore / Setup", "At Sea", "The Fight", "Return Home")))
    for anchor, want in {"At Sea": 1, "at sea (day 2)": 1, "fight": 2, "e": 0, "home-coming return": 3, "zzz": 1, "": 1}.items():
        assert one(spark, stages.stage_index(F.lit(anchor), names)) == want, anchor
    assert one(spark, stages.stage_index(F.lit(None).cast("string"), names)) == 1
    assert one(spark, stages.stage_index(F.lit("A"), F.array(F.lit("A"), F.lit("B"), F.lit("A")))) == 2


def test_broken_taxonomy_gives_defaults(spark):
    for json in ("{broken", None, "[]"):
        assert one(spark, stages.names(stages.parse(F.lit(json).cast("string")))) == list(DEFAULT_STAGES)
