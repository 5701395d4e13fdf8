"""DataFrame operators: segmentation, vocabularies, context, checks, overviews."""
