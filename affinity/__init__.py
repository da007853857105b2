"""affinity — neighbourhood recommendation as composable Spark DataFrame operators.

Stages (all lazy DataFrame in, DataFrame out):

* ``operators.llr``       — interaction caps, co-occurrence, log-likelihood-ratio similarity
* ``operators.graph``     — similarity graph, node2vec transitions, second-order random walks
* ``operators.embed``     — skip-gram embeddings of walk corpora (Spark ML Word2Vec)
* ``operators.knn``       — exact k-nearest neighbours (blocked, no all-pairs rows)
* ``operators.lsh``       — locality-sensitive hashing families and neighbour search
* ``operators.predict``   — neighbour-weighted rating prediction
* ``operators.evaluate``  — RMSE, MAP@k, recall@N
* ``operators.gram``      — Gram-matrix (co-rating) neighbourhood baseline
* ``plans``               — end-to-end chains, parameter sweeps, the query catalogue
"""

__version__ = "0.1.0"
