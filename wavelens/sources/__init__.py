"""Readers of campaign tables, signature registries and instrument exports, and writers of result tables."""
