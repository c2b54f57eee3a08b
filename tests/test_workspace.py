from pyspark.sql import functions as F

from mmops.operators import workspace


def test_folders(spark):
    f = spark.createDataFrame([("r", "jsons-sem", 3, 0), ("r", "jsons-segm", 1, 0), ("r", "jsons", 0, 0), ("r", "jsons-det", 2, 0), ("r", "other", 0, 4), ("r", "Images", 0, 2), ("r", "images", 0, 1), ("r", ".", 0, 1), ("r", ".git", 0, 9)], "root string, folder string, n_labels int, n_images int")
    assert [r.name for r in workspace.label_folder_options(f, ["root"]).orderBy("place").collect()] == ["jsons-segm", "jsons-detect"]
    assert [r.name for r in workspace.image_folder_options(f, ["root"]).orderBy("place").collect()] == [".", "images", "other"]
    wanted = spark.createDataFrame([("r", "IMAGES"), ("r", "jsons-detect"), ("r", "none")], "root string, wanted string")
    assert {r.wanted: r.found for r in workspace.resolve_folder(f, wanted, ["root"]).collect()} == {"IMAGES": "Images", "jsons-detect": "jsons-det", "none": None}
    names = spark.createDataFrame([("jsons-sem",), ("/a/jsons-det/",), ("",), ("x",)], "n string")
    assert [r[0] for r in names.select(workspace.geometry_of_folder(F.col("n"))).collect()] == ["polygon", "rectangle", None, None]


def test_messages(spark):
    part = "struct<type:string,text:string,image:string,image_url:string,video:string>"
    df = spark.createDataFrame([([("text", "hi", None, None, None), (None, None, "a", None, None), ("video", None, None, None, "v"), (None, None, None, None, None)],)], f"content array<{part}>")
    row = df.select(F.size(workspace.vision_items(F.col("content"))), workspace.typed_parts(F.col("content"))).first()
    assert row[0] == 2 and [(p.type, p.value) for p in row[1]] == [("text", "hi"), ("image", "a"), ("video", "v")]
    files = spark.createDataFrame([("d", "b.jpg", "/d/b.jpg", ".jpg"), ("d", "a.jpg", "/d/a.jpg", ".jpg"), ("d", "c.txt", "/d/c.txt", ".txt")], "folder string, name string, path string, suffix string")
    got = workspace.folder_messages(files, "folder", "look", (".jpg",), high=9).first()
    assert [(p.type, p.value, p.max_pixels) for p in got.content] == [("image", "/d/a.jpg", 9), ("image", "/d/b.jpg", 9), ("text", "look", None)]


def test_configuration(spark):
    assert workspace.with_defaults(["--a", "1"], {"a": 2, "b": True, "c": None, "d": {"x": 1}, "e": ""}) == ["--b", "True", "--a", "1"]
    assert workspace.named_argument(["--a=1", "--b", "2", "--b", "3"], "b") == "3" and workspace.named_argument([], "x", "y") == "y"
    maps = spark.range(1).select(workspace.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))).alias("m"))
    assert maps.first().m == {"a": "1", "b": "2"}


def test_clusters(spark):
    chips = spark.createDataFrame([("s", "Red "), ("s", "blue"), ("s", "x")], "scene string, chip string")
    groups = spark.createDataFrame([("s", 0, "colour", ["red", "BLUE"]), ("s", 1, "again", ["red"])], "scene string, group_no int, title string, keys array<string>")
    assert {r.chip: r.title for r in workspace.cluster_chips(chips, groups, ["scene"]).collect()} == {"red": "colour", "blue": "colour", "x": workspace.OTHERS}
    g = "array<struct<title:string,keys:array<string>>>"
    row = spark.createDataFrame([([("a", ["x", "y"]), ("b", ["z"])], [("n", ["z"])], ["Z", "y"])], f"old {g}, new {g}, scope array<string>").select(workspace.merge_clusters(F.col("old"), F.col("new"), F.col("scope"))).first()[0]
    assert [(x.title, x["keys"]) for x in row] == [("a", ["x"]), ("n", ["z"])]


def test_small_operators(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "n int, num_tokens int")
    assert [r.length for r in workspace.lengths_or_ones(df.withColumn("num_tokens", F.lit(None).cast("int")), "n").collect()] == [1, 1]
    assert spark.range(1).select(workspace.caption_budget(F.lit(1)), workspace.caption_budget(F.lit(10)), workspace.caption_budget(F.lit(99))).first()[:] == (256, 544, 1024)
    objects = spark.createDataFrame([("s", i, i % 2 == 0, i % 4 == 0) for i in range(30)], "stem string, obj_id long, wanted boolean, near boolean")
    got = [r.obj_id for r in workspace.cover_chunk(objects, ["stem"], "wanted", "near", "obj_id").orderBy("place").collect()]
    assert got == [0, 4, 8, 12, 16, 20, 24, 28, 2, 6]
    rows = spark.createDataFrame([(1, 0, [[1], [2], [3]]), (1, 1, [[4], [5], [6]])], "b int, o int, positions array<array<int>>")
    assert workspace.concat_positions(rows, ["b"], "o").first().positions == [[1, 4], [2, 5], [3, 6]]
    pairs = spark.createDataFrame([("1 2\n", "1  2"), ("0.5", ".50000001"), ("a", "b"), (None, None), ("1\n\n2", "1\n2")], "got string, want string")
    assert [r.agree for r in workspace.compare_outputs(pairs).collect()] == [True, True, False, True, True]
    assert len(workspace.audit_row(df).first().validated_at) == 19
