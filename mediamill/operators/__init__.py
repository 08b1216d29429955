"""DataFrame operators: reports, statistics and assembly over rows of tags, pixels, words and pages."""
