"""Documents with every awkward case, and plain readings of the contracts."""
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, `row` int, key string, words string, slice string"


def docs(spark, texts, langs=None, sources=None, ids=None):
    """A frame with the columns of ``documents`` and extra ones whose names clash with internal ones."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "src0", len(t or ""), "p", 1, "k", "w", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
