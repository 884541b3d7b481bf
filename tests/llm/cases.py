"""Rows that every operator over documents has to stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, h string, words string, _key string"


def odd_documents(spark):
    """Nulls in any column, empty and white texts, a very long one, repeated rows, and extra columns with names that operators use inside."""
    prose = "the quick brown fox jumps over the lazy dog and runs along the river bank until evening comes again"
    rows = [
        (1, prose, "en", "src1"), (2, prose, "en", "src1"), (2, prose, "en", "src1"), (3, None, None, None), (4, "", "en", "src2"), (5, " \t\n ", None, "src3"),
        (None, "le petit chat dort sur la table avec la souris et le chien", "fr", "src1"), (7, "x" * 50_000, "en", None), (8, "word " * 20_000, "en", "src2"),
        (9, "İstanbul ΣΑΣ 中文 नमस्ते 😀 \U0001F468‍\U0001F469 é", "de", "src4"), (10, "12345 !!! ###", None, "src5"), (11, prose + " x", "en", "src9"),
        (12, "der Hund und die Katze schlafen unter dem Tisch in der Küche und der Garten", "de", "src9"),
    ]
    return spark.createDataFrame([(*r, 0, "h", "w", "k") for r in rows], SCHEMA)


def no_documents(spark):
    return odd_documents(spark).where("false")
