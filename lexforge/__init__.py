"""DataFrame operators for HTML document collections: crawl, extract, catalogue, index, package."""
