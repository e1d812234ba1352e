"""Where responses, robots.txt and sitemaps come from."""
