"""Relational operators over text, detections and rectangles."""
