"""The sieve of texts_of, at the ends of its buckets."""

from tradewind.llm import minhash


def test_texts_of_rows_at_the_ends_of_the_sieve(spark):
    n = minhash.SIEVE
    numbers = [0, n, -n, 1, 32768, 32769, n - 1, -1, 5 * n + 32767]
    rows = spark.createDataFrame([(r, f"t{r}") for r in [*numbers, 7, n + 9]], "row long, text string")
    for wanted in (numbers, [0], numbers[3:]):
        out = minhash.texts_of(rows, spark.createDataFrame([(k, r) for k, r in enumerate(wanted)], "fp long, row long"))
        assert {(r.fp, r.text.decode()) for r in out.collect()} == {(k, f"t{r}") for k, r in enumerate(wanted)}
