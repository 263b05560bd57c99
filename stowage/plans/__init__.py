"""End-to-end work: a manifest in, a plan out, nothing touched."""
