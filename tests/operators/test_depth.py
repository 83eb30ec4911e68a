from findlode.plans import shape
from findlode.plans.text import Corpus


def test_passages_are_verified_beyond_the_first_twenty_documents(spark, small):
    """The depth is the engine's: what ranks 21 to 200 and holds the passage is found too."""
    from findlode import engine

    assert shape.DEPTH == engine.DEPTH
    rank = {(r["query_id"], r["doc_id"]): r["rank"] for r in Corpus(spark, small).ranked(200).collect()}
    for query in (shape.ransac_rerank, shape.match_details):
        places = [rank[r["query_id"], r["doc_id"]] for r in query(spark, small).select("query_id", "doc_id").distinct().collect()]
        assert max(places) > 20
