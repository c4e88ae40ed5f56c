"""Tables that are loaded only if they are what was announced."""

import re

import pytest

from quaystone.sources import readers


@pytest.mark.parametrize(
    "lines,told,fails",
    [
        (["1\ta", "2\tb", "3\t"], {"rows": 3}, []),
        (["1\ta", "2\tb"], {"rows": 3}, ["2 rows instead of 3"]),
        (["1\ta", "2"], {}, ["1 lines of another width"]),
        (["1\ta\tx", "2\tb"], {}, ["1 lines of another width"]),
        (["one\ta", "2\tb"], {}, ["1 lines of another width or type", "a null key"]),
        (["1\ta", "1\tb"], {"digest": "2:0"}, ["a repeated key", "instead of 2:0"]),
        ([], {"rows": 0, "digest": "0:0"}, []),
    ],
)
def test_expectations(spark, tmp_path, lines, told, fails):
    path = tmp_path / "t.tsv"
    path.write_text("".join(x + "\n" for x in lines))

    def load():
        return readers.checked_table(spark, str(path), "k long, v string", ["k"], **told)

    if not fails:
        assert load().count() == len(lines)
        return
    with pytest.raises(ValueError) as e:
        load()
    assert all(re.search(re.escape(f), str(e.value)) for f in fails)


def test_digest(spark):
    rows = [(1, "a"), (2, None), (3, "")]
    a, b, c = (spark.createDataFrame(r, "k long, v string") for r in (rows, rows[::-1], [(1, "a"), (2, ""), (3, None)]))
    one, two, other = (df.agg(readers.row_digest(["k", "v"]).alias("d")).first()["d"] for df in (a, b.repartition(3), c))
    assert one == two != other
