import pytest
from pyspark.sql import functions as F

from skein.functions import stem

ENGLISH = """consistency:consist consisted:consist consistently:consist generations:generat generously:generous hopping:hop
    hoping:hope happy:happi relational:relat conditional:condit skies:sky running:run agreed:agre communism:communism
    communities:communiti controlling:control rate:rate bed:bed shed:shed flies:fli ties:tie gas:gas this:this kiwis:kiwi
    trying:tri dies:die days:day hopefulness:hope digitizer:digit possibly:possibl fully:fulli adoption:adopt
    national:nation rationalize:ration knightly:knight by:by succeed:succeed"""
RUSSIAN = """поколений:поколен поколения:поколен поколениями:поколен общая:общ таблица:таблиц таблицы:таблиц важнейшая:важн
    вернулись:вернул вероятность:вероятн красивый:красив читать:чита читаешь:чита длинный:длин"""


@pytest.mark.parametrize("pair", ENGLISH.split())
def test_english(pair):
    word, want = pair.split(":")
    assert stem.english(word) == want


@pytest.mark.parametrize("pair", RUSSIAN.split())
def test_russian(pair):
    word, want = pair.split(":")
    assert stem.russian(word) == want


def test_stems(spark):
    rows = spark.createDataFrame([("The tables of 3 Общая таблица поколений!",), (None,), ("",)], "t string")
    made = [r[0] for r in rows.select(stem.stems(F.col("t"))).collect()]
    assert made == [["tabl", "3", "общ", "таблиц", "поколен"], None, []]
    assert stem.query_stems("Generations, the generation") == ["generat"]
