"""Queries held against their SQL on rows that only larger tables, or odd ones, hold."""

import duckdb

import __spark_entry__ as entry
from lectern.queries import SQL


def differences(spark, folder, name, **tables):
    """Rows (row, count) that the query and its SQL do not share, over tables of (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(SQL[name])
    columns, counts = [d[0] for d in cursor.description], {}
    for row in cursor.fetchall():
        counts[row] = counts.get(row, 0) + 1
    for r in entry.queries()[name](spark, str(folder)).collect():
        row = tuple(r[c] for c in columns)
        counts[row] = counts.get(row, 0) - 1
    return {row: n for row, n in counts.items() if n}


def parts(*keys):
    return [(k, f"name {k}", "brand", "type", k % 50) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def test_merged_json_of_parts_at_one_place(spark, tmp_path):
    assert not differences(spark, tmp_path, "merged_json", part=parts(4, 100007, 200010, 5, 100009, 1, 2, 3))


def test_created_items_beside_parts_with_their_numbers(spark, tmp_path):
    assert not differences(spark, tmp_path, "trash_and_deletion", part=parts(0, 1, 2, 5, 11, 1000005, 1000011, 1000013, 1999999, 2000005))


DOCUMENT = "doc_id long, text string"


def test_character_embeddings_of_empty_texts_and_shared_ids(spark, tmp_path):
    one = [(1, "añb\n𝒳日x"), (2, ""), (3, None), (4, " ")]
    assert not differences(spark, tmp_path / "one", "character_embeddings", documents=(one, DOCUMENT))
    shared = [*one, (1, "bb é"), (2, ""), (5, ""), (5, "𝒳y"), (None, "one"), (None, "two"), (3, None)]
    assert not differences(spark, tmp_path / "shared", "character_embeddings", documents=(shared, DOCUMENT))


def test_word_piece_counts_of_other_scripts_spaces_and_shared_ids(spark, tmp_path):
    odd = [0x0B, 0x1C, 0x85, 0xA0, 0xAA, 0xB2, 0x130, 0x300, 0x37E, 0x483, 0x5B0, 0x903, 0x1E9E, 0x1FEF, 0x2003, 0x2014, 0x20D0, 0x212A, 0x212B, 0x2260, 0x3000, 0x3002, 0x65E5, 0xAC00, 0xFB01, 0xFF21, 0x1D4B3, 0x1F600, 0xE0100]
    rows = [(c, f"a{chr(c)}b {chr(c)} C{chr(c)}") for c in odd] + [(1, "日本語 テキスト, m² éa"), (2, ""), (3, None), (4, "x" * 5000)]
    assert not differences(spark, tmp_path / "one", "word_piece_counts", documents=(rows, DOCUMENT))
    assert not differences(spark, tmp_path / "shared", "word_piece_counts", documents=([*rows, (1, "a b"), (2, ""), (3, "x"), (None, "x y"), (None, "é"), (-7, "ß")], DOCUMENT))
