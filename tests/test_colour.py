from pyspark.sql import functions as F

from framequarry.operators.integration import integrate, integrate_coloured

SCHEMA = "bx int, by int, bz int, li int, frame long, sdf double, r int, g int, b int, sign int"


def folded(values):
    out = None
    for v in values:
        out = min(254, max(0, v)) if out is None else min(254, max(0, int(0.8 * out + 0.2 * v + 0.5)))
    return out


def test_colours_fold_in_order_and_samples_leave(spark):
    colours = [(200, 3, 90), (10, 255, 91), (77, 128, 254), (0, 0, 0), (255, 255, 255)]
    rows = [(0, 0, 0, 1, f, 0.01 * f, *c, 1) for f, c in enumerate(colours)] + [(0, 0, 0, 1, 2, 0.02, *colours[2], -1)]
    rows += [(0, 0, 0, 2, 5, 0.5, None, None, None, 1), (0, 0, 0, 3, 6, 0.5, 1, 2, 3, 1), (0, 0, 0, 3, 6, 0.5, 1, 2, 3, -1), (0, 0, 1, 0, 6, 0.5, 300, 2, 3, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.bz, r.li): r for r in integrate_coloured(df, F.col("sign")).collect()}
    left = [colours[f] for f in (0, 1, 3, 4)]
    r = got[0, 1]
    assert [r.r, r.g, r.b] == [folded([c[k] for c in left]) for k in range(3)] and r.samples == 4
    assert (0, 3) not in got and got[0, 2].r is None and got[1, 0].r == 254
    plain = {(x.bz, x.li): x.sdf for x in integrate(df, F.col("sign")).collect()}
    assert plain == {k: x.sdf for k, x in got.items()}
