"""Readers and writers: transactions, labelled references, category risks, evaluation sets, index folders."""
