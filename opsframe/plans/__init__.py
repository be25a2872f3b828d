"""Plan-shaping helpers: materialisation, size-checked broadcast, splitting of hot keys."""
