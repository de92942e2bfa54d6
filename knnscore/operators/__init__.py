"""DataFrame operators: clustering, index building, nearest neighbours, voting, evaluation."""
