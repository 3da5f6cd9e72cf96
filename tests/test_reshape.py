import json

from pyspark.sql import functions as F

from drivelaws.operators import reshape as H

CELLS = ['{}', '{"a":1}', '{"a":{"b":1}}', '{"a":1,"b":{"c":2}}', '[1]', '[]', '5', 'junk', None, '{"a":"{}"}', ' {"a":{}} ',
         '{"a":[{"b":1}]}', '"x"', '{"a":{"b":{"c":3}}}', '{"a":"1.5","b":true,"c":null,"d":"x"}', "{'a':1}", '{"a":1} junk', '{"a":1,"a":2}',
         '{"a":"12f","b":"1.5d"}']
# no strict JSON, but what writers of JSON produce
LENIENT = [*CELLS, '{"a":NaN,"b":1}', '{"a":{"b":NaN,"b":-Infinity,"c":{}}}', '{"a":{"b":1},"a":NaN}']


def parsed(cell):
    try:
        value = json.loads(cell) if cell is not None else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def dimension(cell):
    value = parsed(cell)
    if value is None:
        return "H0D"
    return "H2D" if any(isinstance(v, dict) for v in value.values()) else "H1D"


def number(value):
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def exploded(i, cell):
    value = parsed(cell)
    if value is None:
        return [(i, "H0D", "none", "none", number(cell))]
    rows = []
    for a, inner in value.items():
        if isinstance(inner, dict):
            rows += [(i, "H2D", a, b, number(leaf) if not isinstance(leaf, dict) else None) for b, leaf in inner.items()]
        else:
            rows.append((i, "H1D", a, "none", number(inner)))
    return rows


def key(row):
    return tuple(str(v) for v in row)


def frame(spark, cells):
    return spark.createDataFrame(list(enumerate(cells)), "id int, cell string")


def test_dimension_of_each_cell(spark):
    got = {r.id: r.d for r in frame(spark, LENIENT).select("id", H.cell_dimension(F.col("cell")).alias("d")).collect()}
    assert got == {i: dimension(c) for i, c in enumerate(LENIENT)}


def test_explode_drivers_equals_a_walk_of_the_document(spark):
    rows = H.explode_drivers(frame(spark, LENIENT), ["id"], ["cell"]).collect()
    got = [(r.id, r.dimension, r.classA, r.classB, r.correspondant_value) for r in rows]
    want = [row for i, c in enumerate(LENIENT) for row in exploded(i, c)]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_melt_keeps_scalars_and_canonical_maps(spark):
    rows = {r.id: r for r in H.melt_trips(frame(spark, CELLS), ["id"], ["cell"]).collect()}
    assert len(rows) == len(CELLS)
    for i, cell in enumerate(CELLS):
        assert rows[i].dimension == dimension(cell)
        value = parsed(cell)
        if value is None:
            assert rows[i].correspondant_value == cell
        else:
            assert json.loads(rows[i].correspondant_value) == value


def test_explode_matrix_skips_what_is_no_branch_or_number(spark):
    matrix = {"x_axis": "rpm", "x_bins": "min=0;max=9;step=1", "matrix": {
        "A": {"B": {"C": "x", "D": " 1.5 ", "E": None, "F": 2, "G": [1]}, "flat": 3, "list": [1]}, "none": {"none": {"none": 7}},
        "bare": 1, "A2": {"b": {"none": 4}, "empty": {}}}}
    rows = [("s", "c", json.dumps(matrix)), ("t", "c", "none"), ("u", "c", ""), ("v", "c", None), ("w", "c", '{"matrix":{}}')]
    got = H.explode_matrix(spark.createDataFrame(rows, "ref string, label string, m string"), "m", "ref", "label").collect()
    assert sorted((r.ClassA, r.ClassB, r.ClassC, r.Dimension, r.Correspondant_value) for r in got) == [
        ("A", "B", "D", "H3D", 1.5), ("A", "B", "F", "H3D", 2.0), ("A2", "b", "none", "H2D", 4.0), ("none", "none", "none", "H0D", 7.0)]
    assert {r.Dimensions_boudaries for r in got} == {"x_axis=rpm; y_axis=unknown; x_bins=[min=0;max=9;step=1]; y_bins=[]"}


def test_wrap_then_explode_is_identity(spark):
    cells = [("s", "c", a, b, c, float(i)) for i, (a, b, c) in enumerate(
        (a, b, c) for a in "pq" for b in ("x", "none") for c in ("1", "none"))]
    columns = "Study_ref string, Criteria_label string, ClassA string, ClassB string, ClassC string, Correspondant_value double"
    long = spark.createDataFrame(cells, columns)
    back = H.explode_matrix(H.wrap_matrix(long), "dfmatrix", "Study_ref", "Criteria_label")
    assert sorted(back.select(*long.columns).collect()) == sorted(long.collect())


def test_class_dimension_with_a_hole(spark):
    rows = [("a", "b", "c", "H3D"), ("a", "b", "none", "H2D"), ("a", "NONE", "c", "H1D"), ("a", "", None, "H1D"), ("None", "b", "c", "H0D")]
    df = spark.createDataFrame(rows, "a string, b string, c string, want string")
    got = df.select("want", H.class_dimension(F.col("a"), F.col("b"), F.col("c")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_parse_bins(spark):
    df = spark.createDataFrame([("min=-90;max=10410;step=50",), ("min=1;max=x",), ("",)], "s string")
    got = [tuple(r.b) for r in df.select(H.parse_bins(F.col("s")).alias("b")).collect()]
    assert got == [(-90.0, 10410.0, 50.0), (1.0, None, None), (None, None, None)]


def test_wrapped_matrix_text(spark):
    columns = "Study_ref string, Criteria_label string, ClassA string, ClassB string, ClassC string, Correspondant_value double"
    cells = [("s", "l", 'a"é\n', "x", "1", 1.8e7), ("s", "l", 'a"é\n', "x", "2", None), ("s", "l", 'a"é\n', "y", "1", 0.5)]
    bounds = spark.createDataFrame([("s", "l", "rpm", "{0}")], "Study_ref string, Criteria_label string, x_axis string, y_bins string")
    text = H.wrap_matrix(spark.createDataFrame(cells, columns), bounds).first().dfmatrix
    assert text == ('{"x_axis":"rpm","y_axis":"unknown","x_bins":"","y_bins":"{0}","matrix":'
                    '{"a\\"é\\n":{"x":{"1":18000000.0,"2":null},"y":{"1":0.5}}}}')


def test_matrix_cells_are_parsed_and_read_once(spark):
    rows = [("s", "c", '{"matrix":{"A":{"B":{"n":NaN,"k":1,"k":"2","t":true,"x":"12f"}}}}'), ("t", "c", '{"matrix":{"A":{"B":{"k":"\\u00e9"}}}}'),
            ("u", "c", '{"matrix":{"A":{"B":{"k":3}}}}'), ("v", "c", '{"matrix":{"A":{"B":{"k":3}}')]
    got = H.explode_matrix(spark.createDataFrame(rows, "ref string, label string, m string"), "m", "ref", "label")
    assert sorted((r.Study_ref, r.ClassC, str(r.Correspondant_value)) for r in got.collect()) == [
        ("s", "k", "2.0"), ("s", "n", "nan"), ("s", "t", "1.0"), ("u", "k", "3.0")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    # a leaf becomes text once, not again for each place that looks at the number
    assert plan.count("from_json") == 1 and plan.count("StructsToJsonEvaluator") == 1
