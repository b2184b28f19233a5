"""The registered queries of this subpackage, and the SQL of those that SQL can state."""

from mlwatch.llm.bpe import op4_byte_bpe
from mlwatch.llm.centroids import OP12_SQL, op12_centroid_clustering
from mlwatch.llm.chat import OP9_SQL, op9_chat_windows
from mlwatch.llm.language import op3_language_id
from mlwatch.llm.main_text import op2_html_extraction
from mlwatch.llm.mixing import op1_source_mixing
from mlwatch.llm.neighbours import op5_nearest_neighbours
from mlwatch.llm.quality import op6_quality_classifier
from mlwatch.llm.secret_scan import op7_secret_scan
from mlwatch.llm.simhash import op10_simhash_near_dedup
from mlwatch.llm.toxicity import op11_toxicity
from mlwatch.llm.vector_dedup import OP8_SQL, op8_embedding_near_dedup
from mlwatch.llm.whitening import op13_embedding_whitening

QUERIES = {
    query.__name__: query
    for query in (
        op1_source_mixing,
        op2_html_extraction,
        op3_language_id,
        op4_byte_bpe,
        op5_nearest_neighbours,
        op6_quality_classifier,
        op7_secret_scan,
        op8_embedding_near_dedup,
        op9_chat_windows,
        op10_simhash_near_dedup,
        op11_toxicity,
        op12_centroid_clustering,
        op13_embedding_whitening,
    )
}

SQL = {
    "op8_embedding_near_dedup": OP8_SQL,
    "op9_chat_windows": OP9_SQL,
    "op12_centroid_clustering": OP12_SQL,
}
