import pytest
from pyspark.sql import functions as F

from kinrank.operators import prepare
from kinrank.plans import data
from kinrank.sources import ratings as src

SF = "/root/testdata/sf0.001"


def test_split_properties(spark):
    train, test = prepare.prepare_data(data.ratings(spark, SF), data.items(spark, SF))
    assert test.join(train.select("user_id").distinct(), "user_id", "left_anti").count() == 0
    assert test.join(train.select("item_id").distinct(), "item_id", "left_anti").count() == 0
    assert train.join(test, ["user_id", "item_id"]).count() == 0


def test_split_independent_of_partitioning(spark):
    r = data.ratings(spark, SF)
    items = data.items(spark, SF)
    a, _ = prepare.prepare_data(r, items)
    b, _ = prepare.prepare_data(r.repartition(13), items)
    key = lambda df: sorted((x.user_id, x.item_id) for x in df.select("user_id", "item_id").collect())
    assert key(a) == key(b)


def test_singletons_counted_before_removal(spark):
    df = spark.createDataFrame(
        [(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0), (3, 3, 1.0), (3, 1, 1.0)],
        "user_id bigint, item_id bigint, rating double")
    # user 2 and item 3 are singletons, both counted on the input: (2, 2)
    # and (3, 3) go, though item 2 is left with one rating afterwards
    got = sorted((r.user_id, r.item_id) for r in prepare.drop_singletons(df).collect())
    assert got == [(1, 1), (1, 2), (3, 1)]


def test_cap_is_ordered_and_no_task_merges_it(spark):
    r = data.ratings(spark, SF)
    capped = prepare.cap_sample(r, 100)
    assert "TakeOrdered" not in capped._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted((x.user_id, x.item_id) for x in df.collect())
    assert key(capped) == key(r.orderBy("ts", "user_id", "item_id").limit(100))


def test_csv_ids_beyond_32_bits_and_malformed_rows(spark, tmp_path):
    from kinrank.sources import ratings as src

    good = tmp_path / "good.csv"
    good.write_text("userId,movieId,rating,timestamp\n3000000000,7,4.5,1\n")
    assert src.read_ratings_csv(spark, str(good)).first().user_id == 3_000_000_000
    bad = tmp_path / "bad.csv"
    bad.write_text("userId,movieId,rating,timestamp\nx,7,4.5,1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        src.read_ratings_csv(spark, str(bad)).collect()


def test_ratings_in_range(spark):
    r = data.ratings(spark, SF)
    row = r.agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"),
                F.count("*").alias("n")).first()
    assert 0.5 <= row.lo and row.hi <= 5.0
    assert r.select("user_id", "item_id").distinct().count() == row.n


def test_csv_readers(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.5,1112486027\n")
    (tmp_path / "movies.csv").write_text("movieId,title,genres\n2,Jumanji (1995),Adventure\n")
    r = src.read_ratings_csv(spark, str(tmp_path / "ratings.csv")).first()
    assert (r.user_id, r.item_id, r.rating) == (1, 2, 3.5)
    m = prepare.items_with_genre(src.read_items_csv(spark, str(tmp_path / "movies.csv"))).first()
    assert m.year == "1995"


def test_item_year_and_genre_filter(spark):
    items = spark.createDataFrame(
        [(1, "A (1999)", "Drama"), (2, "B (2001)", src.NO_GENRE), (3, "C (2002)", None)],
        "item_id bigint, title string, genres string")
    got = [(r.item_id, r.year) for r in prepare.items_with_genre(items).collect()]
    assert got == [(1, "1999")]


def test_standin_schemas(spark):
    def shape(schema):
        return [(f.name, f.dataType.simpleString()) for f in schema.fields]

    assert shape(data.ratings(spark, SF).schema)[:3] == shape(src.RATINGS_SCHEMA)[:3]
    assert shape(data.items(spark, SF).schema) == shape(src.ITEMS_SCHEMA)


def test_csv_end_to_end(spark, tmp_path):
    """MovieLens-style CSVs through cleaning, split, baseline and neighbours."""
    from kinrank.functions import metrics
    from kinrank.operators import baseline, neighbors

    lines = ["userId,movieId,rating,timestamp"]
    for u in range(1, 31):
        for m in range(1, 13):
            if (u * 7 + m * 3) % 4 != 0:
                lines.append(f"{u},{m},{((u + m) % 10 + 1) / 2},{1_000_000 + u * 100 + m}")
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    movies = ["movieId,title,genres"] + [
        f"{m},Film {m} (19{60 + m}),{src.NO_GENRE if m == 12 else 'Drama'}" for m in range(1, 13)]
    (tmp_path / "m.csv").write_text("\n".join(movies) + "\n")
    r = src.read_ratings_csv(spark, str(tmp_path / "r.csv"))
    m = src.read_items_csv(spark, str(tmp_path / "m.csv"))
    train, test = prepare.prepare_data(r, m)
    assert train.filter("item_id = 12").count() == 0  # no-genre movie removed
    assert test.count() > 0
    b = baseline.rmse(baseline.predict(test, baseline.item_stats(train))).first()["rmse"]
    n = metrics.rmse(neighbors.predict(neighbors.fit(train), test, 5)).first()["rmse"]
    assert b > 0 and n > 0


def test_singleton_sets_are_written_before_the_joins(spark):
    from kinrank.operators import prepare
    from kinrank.plans.context import tables

    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3), (3, 1)], "user_id bigint, item_id bigint")
    before = tables(spark)
    kept = prepare.drop_singletons(rows)
    assert len(tables(spark) - before) == 2
    assert sorted((r.user_id, r.item_id) for r in kept.collect()) == [(1, 1), (3, 1)]
