"""The corpus operators over their whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_simhash(spark, sf_dir):
    """Documents with near-equal SimHash fingerprints of their three-word shingles."""
    from waymark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_repeats(spark, sf_dir):
    """Documents without the bytes of 400-byte strings that occur again."""
    from waymark.llm.repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@query
def op8_decontaminate(spark, sf_dir):
    """Documents with passages of ten words that benchmark items have too."""
    from waymark.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_token_counts(spark, sf_dir):
    """Token counts of documents for a byte-level vocabulary."""
    import public_tokenizers

    from waymark.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_token_files(spark, sf_dir):
    """Documents as token ids, written to plane files and read back."""
    import public_tokenizers

    from waymark.llm.planes import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_warc(spark, sf_dir):
    """Pages as WARC records, read back from the archives."""
    from waymark.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


@query
def op5_mixing(spark, sf_dir):
    """How many words of each document a mix to source targets takes."""
    from waymark.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark, sf_dir):
    """Toxicity scores of documents."""
    from waymark.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_main_text(spark, sf_dir):
    """Main text of web pages."""
    from waymark.llm.extract import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


@query
def op2_fingerprints(spark, sf_dir):
    """Sketch fingerprints of documents, of edited versions and their likeness."""
    from waymark.llm.sketch import fingerprinted

    return fingerprinted(table(spark, sf_dir, "documents"))


@query
def op12_whitening(spark, sf_dir):
    """Embeddings projected on the components of their covariance, scaled to unit variance."""
    from waymark.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_alignment(spark, sf_dir):
    """Documents' tokens of two vocabularies, aligned, with how common their linked pairs are."""
    import public_tokenizers

    from waymark.llm.alignment import aligned

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_setsketch(spark, sf_dir):
    """Documents with near-equal sets of two-word shingles."""
    from waymark.llm.setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))
