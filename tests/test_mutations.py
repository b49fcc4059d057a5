from pyspark.sql import functions as F

from evolvent.operators import mutations
from evolvent.plans.api_queries import mutation_benchmark


def test_every_change_made_is_judged(spark):
    got = {r["strategy"]: (r["n_cases"], r["n_binary"], r["n_source"]) for r in mutation_benchmark(spark, "").collect()}
    # Half of the generated types are package-private, where no change can be seen.
    for s in ("RemoveMethod", "AddParameterMethod", "ChangeParameterMethod", "RemoveParameterMethod", "ChangeVisibilityMethod", "RemoveType", "RemoveConstructor"):
        n, binary, source = got[s]
        assert (binary, source) == (n // 2, n // 2), s
    for s in ("AddExceptionMethod", "RemoveExceptionMethod", "AddExceptionConstructor", "RemoveExceptionConstructor"):
        n, binary, source = got[s]
        assert (binary, source) == (0, n // 2), s
    for s in ("AddImplementedInterfaceType", "AddSuperClassClass", "RemoveModifierFinalMethod", "RemoveModifierFinalField", "RemoveModifierAbstractType"):
        assert got[s][1:] == (0, 0), s
    assert got["RemoveEnumValue"] == (2, 1, 1)
    assert got["RemoveModifierStaticField"][1] == got["RemoveModifierStaticField"][0] // 2 and got["AddModifierStaticField"][2] == 0


def test_names_of_changes_are_distinct():
    names = [n for _, n, _ in mutations.STRATEGIES]
    assert len(names) == len(set(names)) == 41 and set(names) == set(mutations.LONG_NAMES)


def test_uniform_names(spark):
    assert len(mutations.PATTERNS) == 35
    rows = [("RemoveEnumValue", "p.Color.RED"), ("ChangeTypeMethod", "p.q.Dial.turn(int,p.X)"), ("RemoveModifierFinalType", "p.A$B"), (None, "p.A")]
    df = spark.createDataFrame(rows, "strategy string, symbol string").withColumn("name", mutations.long_name(F.col("strategy"), F.col("symbol")))
    got = [tuple(r) for r in df.select("name", mutations.uniform_name(F.col("name"))).collect()]
    assert got == [
        ("RemoveEnumValueREDInpColor", "^RemoveEnumValue.+In.+$"), ("ChangeMethodturnInpqDialTypeToThread", "^ChangeMethod.+In.+TypeTo.+$"),
        ("RemoveFinalModifierInAB", "^Remove.+ModifierIn.+$"), (None, None),
    ]
