"""DataFrame operators: blocks, itemsets, clustering, trees, linear models, votes."""
