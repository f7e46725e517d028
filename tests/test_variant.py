from surveyq.functions import variant as J

ROWS = [
    (1, '{"a": 1, "b": {"c": "x", "d": 1.5}, "l": [1, 2], "o": [{"p": 1}]}'), (2, '{"a": 2, "b": {"c": 5}, "l": [], "q\'": true}'),
    (3, '{"a": null, "l": null}'), (4, "{broken"), (5, None), (6, "[1]"), (7, "3"), (8, ""),
]


def test_paths_and_typed_columns(spark):
    df = spark.createDataFrame([(*r, "keep") for r in ROWS], "id long, props string, parsed string")
    objects = df.where("id < 6")
    found = {p.keys: p.kind for p in J.paths(objects, "props")}
    assert found == {("a",): "bigint", ("b", "c"): "string", ("b", "d"): "decimal(2,1)", ("l",): "array<bigint>", ("o",): "array<struct<`p`:bigint>>", ("q'",): "boolean"}
    rows = {r.id: r for r in J.shredded(objects, "props").collect()}
    assert (rows[1].a, rows[1].b_c, float(rows[1].b_d), rows[1].l, rows[1].o[0].p) == (1, "x", 1.5, [1, 2], 1)
    assert (rows[2].b_c, rows[2].l, rows[2]["q'"], rows[2].o) == ("5", [], True, None)
    assert all(rows[i].a is None and rows[i].l is None for i in (3, 4, 5)) and rows[1].parsed == "keep"
    assert J.paths(df, "props") == [] and J.paths(df.where("false"), "props") == []  # not objects throughout, or no row
    assert J.shredded(df, "props", [J.Path(("a",), "string")], "x_").columns == ["id", "props", "parsed", "x_a"]
