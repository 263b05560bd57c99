"""Where manifests, tags and digests come from."""
