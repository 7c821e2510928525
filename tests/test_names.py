import unicodedata

import pytest
from pyspark.sql import functions as F

from litlake.functions import names


def one(spark, c, *values):
    row = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return row.select(c).first()[0]


@pytest.mark.parametrize(
    "name, key, inverted",
    [
        ("Ada Lovelace", "lovelace", "Lovelace, Ada"),
        ("Henk van Tilborg", "vantilborg", "van Tilborg, Henk"),
        ("Oscar de la Hoya", "delahoya", "de la Hoya, Oscar"),
        ("Van Morrison", "vanmorrison", "Van Morrison"),
        ("Plato", "plato", "Plato"),
        ("  José  Núñez ", "nunez", "Núñez, José"),
        ("van", "van", "van"),
        ("A de B C", "c", "C, A de B"),
        ("Łukasz Øst", "øst", "Øst, Łukasz"),
    ],
)
def test_surnames(spark, name, key, inverted):
    assert one(spark, names.surname_key(F.col("c0")), name) == key
    assert one(spark, names.inverted_name(F.col("c0")), name) == inverted


def test_accents_follow_unicode(spark):
    text = "àÉîõüçñšžåÅąęțÿ ﬁ ﬃ đłø ΐ й"
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    assert one(spark, names.fold_accents(F.col("c0")), text) == plain


def test_author_list_skips_empty(spark):
    df = spark.createDataFrame([(["Ada Lovelace", "", None, "Plato"],)], "a array<string>")
    assert df.select(names.author_list(F.col("a"))).first()[0] == "Lovelace, Ada and Plato"


@pytest.mark.parametrize(
    "author, year, title, key",
    [
        ("Ada Lovelace", "1843", "On the Analytical Engine", "lovelace1843analytical"),
        (None, None, "", "unknownuntitled"),
        ("Plato", "2020", "The of and", "plato2020untitled"),
        ("Plato", "2020", "Étude de cas", "plato2020tude"),
        ("Plato", "2020", "3D-vision 2", "plato2020d"),
    ],
)
def test_citation_keys(spark, author, year, title, key):
    df = spark.createDataFrame([(author, year, title)], "a string, y string, t string")
    assert df.select(names.citation_key(F.col("a"), F.col("y"), F.col("t"))).first()[0] == key


def test_escapes(spark):
    assert one(spark, names.escape_bibtex(F.col("c0")), "a & b_c 5% #1 $x") == r"a \& b\_c 5\% \#1 $x"


def test_blank_names_and_capital_particles(spark):
    assert one(spark, names.inverted_name(F.col("c0")), "  ") == ""
    assert one(spark, names.surname_key(F.col("c0")), " \t") == "unknown"
    assert one(spark, names.inverted_name(F.col("c0")), "Ivan VAN  Der Berg") == "VAN Der Berg, Ivan"
    assert one(spark, names.citation_key(F.col("c0"), F.lit(1), F.lit("The andes")), "Zoë Ǆurić") == "dzuric1andes"
